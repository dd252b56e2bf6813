"""Mixing sources to target weights by capped water-filling. Native: DataFrame functions only.

Each source gets a target in words: its weight's part of the wanted total, clamped at max_epochs times its
size; what clamped sources leave is dealt to the others by weight until none is above its clamp. With the
sources sorted by clamp over weight, the clamped ones are a prefix, so the level is found from running sums.

A document is repeated floor(target / size of the source) times, and once more if its seeded number u in
[0, 1) lies under the source's cut. The cut is read off a histogram of words over u (4,096 bins a source,
summed before the shuffle) to the nearest bin, so that the words taken come near the target even where sizes
are uneven: within half a document where bins hold one, within 1/8,192 of a large source.

Null texts have size 0; null sources form one source, the last; equal ids share one u. An empty table gives
an empty result. Columns of the input that have an output column's name are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, stage, table

BINS = 4096
OUT = ("size", "source_size", "target", "taken", "copies", "_u", "_whole", "_cut", "_source")


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the key's text and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(16**12))


def plan(sized: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(_source, source_size, target, _whole, _cut) from sized(_source, size, _u). One row a source."""
    bins = sized.groupBy("_source", F.floor(F.col("_u") * BINS).alias("bin")).agg(F.sum("size").alias("words"))
    bins = stage(bins, "mix-bins")  # at most 4,096 rows a source
    every, up = Window.partitionBy(), Window.orderBy("ratio", "rank")
    total = F.sum("source_size").over(every)
    s = bins.groupBy("_source").agg(F.sum("words").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("clamp", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumn("ratio", F.col("clamp") / F.col("weight")).withColumn("wanted", total * F.lit(float(share)))
    s = s.withColumn("gone", F.coalesce(F.sum("clamp").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("wanted") - F.col("gone")) / F.col("rest")).withColumn("k", F.row_number().over(up))
    free = F.when(F.col("clamp") >= F.col("weight") * F.col("level"), F.struct("k", "level"))
    s = s.withColumn("level", F.min(free).over(every)["level"])
    s = s.withColumn("target", F.coalesce(F.least(F.col("clamp"), F.col("weight") * F.col("level")), F.col("clamp")))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    s = s.withColumn("_whole", F.floor(epochs)).withColumn("goal", (epochs - F.floor(epochs)) * F.col("source_size"))
    s = s.select("_source", "source_size", "target", "_whole", "goal")
    run = Window.partitionBy("b._source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = bins.alias("b").join(small(s).alias("s"), F.col("b._source").eqNullSafe(F.col("s._source")))
    c = c.withColumn("cum", F.sum("words").over(run)).where((F.col("cum") >= F.col("goal")) & (F.col("words") > 0) & (F.col("goal") > 0))
    c = c.groupBy("b._source").agg(F.min(F.struct("bin", "cum", "words", "goal")).alias("x"))
    over = F.col("x.goal") - (F.col("x.cum") - F.col("x.words"))  # what the last bin should give; it comes whole or not at all
    cut = (F.col("x.bin") + F.when(over * 2 >= F.col("x.words"), 1).otherwise(0)) / F.lit(float(BINS))
    c = c.select(F.col("_source").alias("_s"), cut.alias("_cut"))
    return s.join(c, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("_cut", F.coalesce("_cut", F.lit(0.0)))


def apply_plan(df: DataFrame, plan: DataFrame, source: str, key: str, seed: int) -> DataFrame:
    """df with source_size, target and copies (times that the mix takes the row)."""
    p = small(stage(plan, "mix-plan"))
    df = df.withColumn("_u", uniform(key, seed)) if "_u" not in df.columns else df
    out = df.join(p, F.col(source).eqNullSafe(F.col("_source")), "left")
    return out.withColumn("copies", (F.col("_whole") + F.when(F.col("_u") < F.col("_cut"), 1).otherwise(0)).cast("int")).drop("_u", "_whole", "_cut", "_source")


def sizes(docs: DataFrame, text: str, source: str, key: str, seed: int) -> DataFrame:
    """The narrow table that both passes read: texts are scanned once."""
    return stage(docs.select(F.col(key).alias("key"), F.col(source).alias("_source"), words(text).alias("size"), uniform(key, seed).alias("_u")), "mix-sizes")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 11, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with every row repeated as often as the mix takes it; rows that it doesn't take are gone."""
    docs = docs.drop(*(c for c in OUT if c in docs.columns and c not in (text, source, key)))
    p = plan(sizes(docs, text, source, key, seed), weights, share, max_epochs)
    kept = apply_plan(docs, p, source, key, seed).where(F.col("copies") > 0)
    columns = [F.col(c) for c in docs.columns]
    return kept.select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def mix_report(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 11, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(key, size, source_size, target, taken, copies): what the mix takes of each row."""
    sized = sizes(docs, text, source, key, seed)
    p = plan(sized, weights, share, max_epochs)
    out = apply_plan(sized.withColumnRenamed("_source", "src"), p, "src", "key", seed)
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op1_mixing(spark, sf_dir):
    return mix_report(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM {documents}),
bins AS (SELECT source, floor(u * 4096)::BIGINT AS bin, sum(size)::BIGINT AS words FROM sized GROUP BY ALL),
a AS (SELECT source, sum(words)::BIGINT AS source_size FROM bins GROUP BY source),
b AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM a),
c AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((rank - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS clamp, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS wanted FROM b),
d AS (SELECT *, clamp / weight AS ratio FROM c),
e AS (SELECT *, coalesce(sum(clamp) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
  sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER (ORDER BY ratio, rank) AS k FROM d),
f AS (SELECT *, (wanted - gone) / rest AS lev FROM e),
g AS (SELECT *, (SELECT arg_min(lev, k) FROM f WHERE clamp >= weight * lev) AS level FROM f),
h AS (SELECT source, source_size, coalesce(least(clamp, weight * level), clamp) AS target FROM g),
i AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS epochs FROM h),
j AS (SELECT source, source_size, target, floor(epochs)::BIGINT AS whole, (epochs - floor(epochs)) * source_size AS goal FROM i),
k AS (SELECT bins.source, bin, words, goal, sum(words) OVER (PARTITION BY bins.source ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum
  FROM bins JOIN j ON bins.source IS NOT DISTINCT FROM j.source),
l AS (SELECT source, arg_min((bin + CASE WHEN (goal - (cum - words)) * 2 >= words THEN 1 ELSE 0 END) / 4096.0::DOUBLE, bin) AS cut FROM k WHERE cum >= goal AND words > 0 AND goal > 0 GROUP BY source)
SELECT sized.*, source_size, target, whole + CASE WHEN u < coalesce(cut, 0) THEN 1 ELSE 0 END AS copies
FROM sized JOIN j ON sized.source IS NOT DISTINCT FROM j.source LEFT JOIN l ON sized.source IS NOT DISTINCT FROM l.source"""
QUERIES = {"op1_mixing": op1_mixing}
SQL = {"op1_mixing": f"SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::INT AS copies FROM ({MIX_SQL.replace('{documents}', 'documents')})"}
