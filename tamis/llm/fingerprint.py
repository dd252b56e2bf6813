"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests. Native: SQL functions only.

A text's paragraphs are its pieces up to a line's end or a sentence mark; each has a 60-bit digest. A sketch
has three tables of `per` cells; a digest is counted in one cell of each, with the XOR of digests and of their
checks. Two sketches of one size are subtracted cell by cell; a cell that holds exactly one digest gives it
away, it is taken out of its other cells, and so on (peeling) until no cell is left: then the digests in which
the texts differ are known. Where peeling gets stuck, or the smallest digests have nothing in common, both are
sketched anew with larger tables: for 3, 6 and 12 times as many cells as both have digests. Should all fail,
the sets are compared directly.

likeness = 1 - differing / (digests of one + digests of the other); two texts without paragraphs: 1.

Null is the empty text, whose sketch is empty. Equal texts have equal sketches. The next document is found by
ranges of integer ids, not by one global sort; rows with equal ids are ordered by their texts' MD5, null ids are
last. Ranges of one id with very many rows, or of null ids, are cut by that MD5.
A table of one row is its own next document. Columns named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

PER = 24  #: cells in each of the three tables of a published sketch
PRIME = 2147483647
ROUNDS = 60
LEAST = 8  #: smallest digests of each text that tell whether the published size can do
CELL = "struct<i:int,n:int,k:bigint,c:bigint>"
NONE = f"cast(array() as array<{CELL} >)"


def let(name: str, value: str, body: str) -> str:
    """body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digests(text: str) -> str:
    """Distinct paragraph digests of a column."""
    pieces = f"regexp_extract_all(coalesce({text}, ''), '[^\\\\n.!?]+[.!?]*', 0)"
    return f"array_distinct(transform(filter(transform({pieces}, p -> btrim(p)), p -> p <> ''), p -> cast(conv(substring(md5(p), 1, 15), 16, 10) as bigint)))"


def entries(keys: str, per: str, of: str, sign: str) -> str:
    """Three cells for each element d of keys; of: the digest in d, sign: its count."""
    cell = lambda j: f"named_struct('i', cast((shiftright({of}, {20 * j}) & 1048575) % {per} + {j} * {per} as int), 'n', {sign}, 'k', {of}, 'c', {of} % {PRIME})"
    return f"flatten(transform({keys}, d -> array({cell(0)}, {cell(1)}, {cell(2)})))"


def combine(cells: str, tag: str) -> str:
    """Cells of the same place summed up, empty ones left out; in order of places."""
    v, st, j, s, t, m, e, x = (f"{y}_{tag}" for y in ("v", "st", "j", "s", "t", "m", "e", "x"))
    many = f"coalesce(get({st}, {t} + 1), size({v})) - {s}"
    merged = f"aggregate(slice({v}, {s} + 2, {many} - 1), {v}[{s}], ({m}, {e}) -> named_struct('i', {m}.i, 'n', {m}.n + {e}.n, 'k', {m}.k ^ {e}.k, 'c', {m}.c ^ {e}.c))"
    runs = f"transform({st}, ({s}, {t}) -> if({many} = 1, {v}[{s}], {merged}))"
    first = f"filter(sequence(0, size({v}) - 1), {j} -> {j} = 0 or {v}[{j}].i <> {v}[{j} - 1].i)"  # where runs of one place begin
    whole = let(st, first, f"filter({runs}, {x} -> {x}.n <> 0 or {x}.k <> 0 or {x}.c <> 0)")
    return let(v, f"sort_array({cells})", f"if(size({v}) = 0, {NONE}, {whole})")


def sketch(keys: str, per: str, tag: str) -> str:
    return combine(entries(keys, per, "d", "1"), tag)


def subtract(a: str, b: str, tag: str) -> str:
    return combine(f"concat({a}, transform({b}, x -> named_struct('i', x.i, 'n', -x.n, 'k', x.k, 'c', x.c)))", tag)


def peel(cells: str, per: str, tag: str) -> str:
    """Number of digests recovered from a difference; null where it gets stuck."""
    z, w, u = (f"{x}_{tag}" for x in ("z", "w", "u"))
    pure = f"array_distinct(transform(filter({z}.cells, x -> abs(x.n) = 1 and x.c = x.k % {PRIME}), x -> shiftleft(x.k, 1) + if(x.n < 0, 1, 0)))"  # longs, which are told apart by hashing
    rest = combine(f"concat({z}.cells, {entries(u, per, 'shiftright(d, 1)', 'if(d % 2 = 0, -1, 1)')})", f"{tag}r")
    step = let(u, pure, f"if(size({u}) = 0, named_struct('cells', {z}.cells, 'found', {z}.found, 'on', false), named_struct('cells', {rest}, 'found', {z}.found + size({u}), 'on', true))")
    start = f"named_struct('cells', {cells}, 'found', 0, 'on', true)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, ({z}, {w}) -> if(size({z}.cells) = 0 or not {z}.on, {z}, {step}), {z} -> if(size({z}.cells) = 0, {z}.found, null))"


def differing(a: str, b: str, base_a: str, base_b: str, tag: str) -> str:
    """Number of digests in one set only: from the published sketches, else from larger ones.

    base_b is worked out only where it is used. Texts that share none of their smallest digests differ too much for the published size, so they begin with
    the next.
    """
    least = lambda x: f"slice(sort_array({x}), 1, {LEAST})"
    tries = [f"if(arrays_overlap({least(a)}, {least(b)}), {peel(subtract(base_a, base_b, f'{tag}s0'), str(PER), f'{tag}p0')}, null)"]
    for k, times in enumerate((1, 2, 4), 1):
        per = f"per_{tag}{k}"
        larger = combine(f"concat({entries(a, per, 'd', '1')}, {entries(b, per, 'd', '-1')})", f"{tag}s{k}")  # one sketch less the other
        tries.append(let(per, f"cast(ceil((size({a}) + size({b})) * {times}) + {PER} as bigint)", peel(larger, per, f"{tag}p{k}")))
    return f"coalesce({', '.join(tries)}, size(array_except({a}, {b})) + size(array_except({b}, {a})))"


def likeness(a: str, b: str, base_a: str, base_b: str, tag: str) -> str:
    return f"if({a} = {b}, 1D, 1D - {differing(a, b, base_a, base_b, tag)} / cast(size({a}) + size({b}) as double))"


def written(cells: str) -> str:
    return f"array_join(transform({cells}, x -> concat_ws(':', x.i, x.n, x.k, x.c)), ' ')"


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with paragraphs (array of digests), cells (sketch) and fingerprint (the sketch as text)."""
    docs = docs.drop(*(c for c in ("paragraphs", "cells", "fingerprint") if c in docs.columns))
    out = docs.withColumn("paragraphs", F.expr(digests(f"`{text}`"))).withColumn("cells", F.expr(sketch("paragraphs", str(PER), "f")))
    return out.withColumn("fingerprint", F.expr(written("cells")))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _text, _next): each row's text and that of the row with the next smaller key; the last gets the first's.

    Rows are dealt to ranges of keys; the first row of each is also given to the range before it.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(16, min(4096, 2 * parts))
    d = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    cuts = d.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    coarse = cuts[63::64]
    longs = lambda xs: F.array(*(F.lit(x) for x in xs)).cast(f"array<{docs.schema[key].dataType.simpleString()}>")

    def below(xs: Column) -> Column:
        return F.size(F.filter(xs, lambda x: x < F.col(key)))

    c = below(longs(coarse)) if coarse else F.lit(0)
    rank = c * 64 + below(F.slice(longs(cuts), c * 64 + 1, F.lit(64))) if cuts else F.lit(0)
    d = d.withColumn("_part", F.when(F.col(key).isNull(), 0).otherwise(rank + 1).cast("int"))
    seen = {r[0]: r for r in d.groupBy("_part").agg(F.min(key), F.max(key), F.count("*")).collect()}  # n + 1 rows at most
    even = max(1.0, sum(r[3] for r in seen.values()) / n)
    # a range of one id (or of null ids) can't be cut by ids: it is cut by its texts' hashes, which order its rows
    cut = [min(256, int(seen[p][3] / even) + 1) if p in seen and seen[p][1] == seen[p][2] else 1 for p in range(len(cuts) + 2)]
    return _lead(d, cut, key)


def _lead(d: DataFrame, cut: list[int], key: str) -> DataFrame:
    """The window of with_next over d's ranges, each cut into some pieces. Range 0 has the null keys, the last in order."""
    at = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i)
    first = [sum(cut[:p]) for p in range(len(cut))]
    pieces = at(cut, F.col("_part"))
    d = d.withColumn("_h", F.when(pieces > 1, F.md5("_text")))
    sub = F.when(pieces > 1, F.floor(F.conv(F.substring("_h", 1, 2), 16, 10).cast("int") * pieces / 256)).otherwise(0)
    d = d.withColumn("_p", (at(first, F.col("_part")) + sub).cast("int"))
    heads = {r[0]: r[1] for r in d.groupBy("_p").agg(F.min(F.struct(F.bitwise_not(key).alias("k"), F.col("_h").alias("h")))).collect()}  # a row a piece
    order = [p for part in [*range(len(cut) - 1, 0, -1), 0] for p in range(first[part], first[part] + cut[part]) if p in heads]  # in order of rows
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the first piece's head goes to the last: -1 wraps
    every = range(sum(cut))
    spot = lambda p, g: F.struct(p.alias("p"), F.lit(g).alias("g"))
    if order:
        kind = d.schema[key].dataType
        most = at([None if p not in heads or heads[p].k is None else ~heads[p].k for p in every], F.col("_p")).cast(kind)
        least = at([heads[p].h if p in heads else None for p in every], F.col("_p")).cast("string")
        leads = F.col(key).eqNullSafe(most) & F.col("_h").eqNullSafe(least)
        spots = F.when(leads, F.array(spot(F.col("_p"), 0), spot(at([before.get(p, -1) for p in every], F.col("_p")), 1))).otherwise(F.array(spot(F.col("_p"), 0)))
    else:
        spots = F.array(spot(F.col("_p"), 0))
    d = d.withColumn("_spot", F.explode(spots))
    w = Window.partitionBy("_spot.p").orderBy("_spot.g", F.col(key).desc_nulls_last(), F.md5("_text"))
    return d.withColumn("_next", F.lead("_text").over(w)).where(F.col("_spot.g") == 0).select(key, "_text", "_next")


def compare_versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text beside an edited one: its last third is replaced by the beginning of the next document."""
    d = with_next(docs, key, text).withColumn("n_chars", F.length("_text").cast("long"))
    d = d.withColumn("edited", F.expr("concat(substring(_text, 1, cast(n_chars - n_chars div 3 as int)), substring(_next, 1, cast(n_chars div 3 as int)))"))
    d = d.withColumns({"a": F.expr(digests("_text")), "b": F.expr(digests("edited")), "c": F.expr(digests("_next")), "edited_sha256": F.sha2("edited", 256)})
    d = d.select(key, "n_chars", "edited_sha256", "a", "b", "c")
    d = d.withColumns({x + "s": F.expr(sketch(x, str(PER), x)) for x in "ab"})
    return d.select(
        key, "n_chars", "edited_sha256", F.expr(written("`as`")).alias("fingerprint"), F.expr(written("bs")).alias("edited_fingerprint"),
        F.expr(likeness("a", "b", "`as`", "bs", "e")).alias("near_edited"), F.expr(likeness("a", "c", "`as`", sketch("c", str(PER), "c"), "n")).alias("near_next"),
    )


def op10_document_fingerprints(spark, sf_dir):
    return compare_versions(table(spark, sf_dir, "documents"))


QUERIES = {"op10_document_fingerprints": op10_document_fingerprints}
_PIECES = r"list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[^\n.!?]+[.!?]*'), lambda p: trim(p, ' ')), lambda p: p <> ''))"
SQL = {
    "op10_document_fingerprints": f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, ''))) AS r, doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT *, coalesce(lead(text) OVER (ORDER BY r), first_value(text) OVER (ORDER BY r)) AS nxt, length(text) AS n_chars FROM d),
f AS (SELECT *, substr(text, 1, n_chars - n_chars // 3) || substr(nxt, 1, n_chars // 3) AS edited FROM e),
g AS (SELECT *, {_PIECES.format('text')} AS a, {_PIECES.format('edited')} AS b, {_PIECES.format('nxt')} AS c FROM f),
p AS (SELECT r, 'a' AS v, unnest(a) AS p FROM g UNION ALL SELECT r, 'b', unnest(b) FROM g),
q AS (SELECT DISTINCT r, v, ('0x' || substr(md5(p), 1, 15))::BIGINT AS k FROM p),
s AS (SELECT r, v, (((k >> (20 * j)) & 1048575) % {PER} + j * {PER}) AS i, count(*) AS n, bit_xor(k) AS k, bit_xor(k % {PRIME}) AS c FROM q, (VALUES (0), (1), (2)) AS t(j) GROUP BY ALL),
w AS (SELECT r, v, string_agg(concat_ws(':', i, n, k, c), ' ' ORDER BY i) AS f FROM s GROUP BY ALL)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256, coalesce(x.f, '') AS fingerprint, coalesce(y.f, '') AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE 1 - (len(a) + len(b) - 2 * len(list_intersect(a, b)))::DOUBLE / (len(a) + len(b)) END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1 ELSE 1 - (len(a) + len(c) - 2 * len(list_intersect(a, c)))::DOUBLE / (len(a) + len(c)) END AS near_next
FROM g LEFT JOIN w x ON x.r = g.r AND x.v = 'a' LEFT JOIN w y ON y.r = g.r AND y.v = 'b'"""
}
