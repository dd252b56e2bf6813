"""From raw documents to token ids in five stages. Each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import bpe, jaccard, langid, mixing, quality
from tamis.llm.common import crc_mod, small, stage, table


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """docs with columns of these names renamed, and what selects all columns under their own names again."""
    new = {c: f"{c}__own" if c in names else c for c in docs.columns}
    return docs.select(*(F.col(c).alias(n) for c, n in new.items())), [F.col(n).alias(c) for c, n in new.items()]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; fitted on labels of ids that aren't held out."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    docs, columns = aside(docs, "score")
    scored = quality.score(docs, model, keep=tuple(docs.columns))
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents for which a language is named; only those without letters go."""
    model = langid.train(docs.where(crc_mod("doc_id", 3) != 1))
    docs, columns = aside(docs, "lang_pred", "score")
    named = langid.identify(docs, model, keep=tuple(docs.columns))
    return named.where(F.col("lang_pred") != "und").select(*columns)


def row_key():
    """A row's doc_id and its text's hash as bytes that sort by id as a number, null ids last, then by hash."""
    eight = lambda x: F.lpad(F.hex(x), 16, "0")
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(2**63)))
    return F.unhex(F.concat(F.when(F.col("doc_id").isNull(), "01").otherwise("00"), eight(number), eight(F.xxhash64("text"))))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id (null ids last), then text hash, of each group of near duplicates; of rows with one id and text, one."""
    groups = stage(jaccard.near_duplicates(docs.select(row_key().alias("doc_id"), "text")), "groups")
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__row"))
    kept = docs.withColumn("__row", row_key()).join(small(gone), "__row", "left_anti").select(*docs.columns)
    if groups.groupBy("doc_id").count().where("count > 1").take(1):
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    docs, columns = aside(docs, *mixing.OUT)
    return mixing.mix_sources(docs).select(*columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of what they decode to."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]
#: The first two stages are fitted models, which SQL can't express; tests/llm holds the rest against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
