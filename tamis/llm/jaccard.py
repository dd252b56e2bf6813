"""N-gram Jaccard join: near-duplicate groups of documents by exact similarity of word shingles.

1. Every shingle's document frequency is counted (keycount), for all documents.
2. Shingles are ordered rare first. Two sets with Jaccard similarity t share one of their first
   n - ceil(t n) + 1 shingles, so only these are candidates' keys, and those of a single document drop out.
3. Sets that share a key form candidate clusters (stars per key, then components; no pairs are made).
4. Each cluster's sets meet in one task and a signature tree finds the links: nodes hold OR-combined bitmaps
   and size ranges, a dual traversal prunes pairs of nodes by the largest possible overlap, and what is left
   is compared in full. Large clusters meet in tiles, each with the same pivots; what the pivots don't
   connect to the main component then meets the cluster's other tiles.
5. Components of the links give each document the smallest id reachable.

Equal sets are one node from the beginning, so groups of copies cost one comparison. Nothing is capped: the
order of shingles and the pruning only leave out pairs that cannot be linked. Shingles are 64-bit hashes.

Null texts, texts without words: empty set, linked with nothing. Fewer words than the shingle size: the
whole sequence is the one shingle. Null ids take part, and equal ids with different texts are different
documents. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import keycount as kc
from .common import small, stage, table
from .components import components
from .sigtree import Forest, links
from .textkernel import M1, M2, M3, mix, slabs, word_hashes

TILE, SETS = 4_000_000, 192  #: shingles and sets of a cluster that meet in one task; larger clusters are cut into tiles of half that
PIVOTS = 12  #: sets of a large cluster, by a hash and on average, that every tile of it meets
CUT = np.uint64(64 - kc.BITS)


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by text and hash, and their texts' numbers."""
    word, doc = word_hashes(buf, offsets)
    n = len(offsets) - 1
    each = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(each)[:-1]])
    many = np.maximum(each - width + 1, np.minimum(each, 1))
    owner = np.repeat(np.arange(n), many)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner]
    size = np.minimum(each, width)[owner]
    h = size.astype(np.uint64) * M3
    for k in range(width):
        own = size > k
        w = word[np.minimum(at + k, len(word) - 1)] if len(word) else np.zeros(0, np.uint64)
        h = np.where(own, mix(h * M1 + w * M2), h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def set_id(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One signed 64-bit id for each set h[cut[i]:cut[i + 1]]."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ M3), dtype=np.uint64)])
    return mix((total[cut[1:]] - total[cut[:-1]]) ^ (np.diff(cut).astype(np.uint64) * M1)).view(np.int64)


def describe(docs: DataFrame, text: str, key: str, width: int, percent: int) -> DataFrame:
    """Staged (id, n, sid, keys, members): keys are the candidates' keys, members the set where there are keys."""
    shares, bits = kc.layout(docs, text)
    dealt = kc.dealt(docs, key, text, shares, kc.COUNTED)

    def ask(buf: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        h, doc = shingles(buf, offsets, width)
        return [(h >> CUT, doc)]

    def both(buf: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        h, doc = shingles(buf, offsets, width)
        return [(h >> CUT, doc), (h, doc)]

    answers = kc.answers(dealt, ask, bits)
    schema = f"id {docs.schema[key].dataType.simpleString()}, n long, sid long, keys binary, members binary"

    def select(cls: int, rows: pa.Table, known) -> pa.RecordBatch:
        (short, doc), (h, _) = kc.extracted(rows.column("text"), both)
        frequency = known(0)[np.unique(short, return_inverse=True)[1]] if len(h) else np.zeros(0, np.int64)
        cut = np.searchsorted(doc, np.arange(rows.num_rows + 1))
        size = np.diff(cut)
        sid = set_id(h, cut)
        prefix = size - (percent * size + 99) // 100 + 1
        order = np.lexsort((h, frequency, doc))
        rank = np.arange(len(h)) - cut[doc]
        chosen = (rank < prefix[doc]) & (frequency[order] > 1)
        keys, members, sids = [], [], []
        for i in range(rows.num_rows):
            a, b = int(cut[i]), int(cut[i + 1])
            sids.append(int(sid[i]) if b > a else None)
            own = h[order[a:b][chosen[a:b]]]
            keys.append(own.tobytes() if len(own) else None)
            members.append(h[a:b].tobytes() if len(own) else None)
        return pa.RecordBatch.from_arrays([rows.column("id").combine_chunks(), pa.array(size, pa.int64()), pa.array(sids, pa.int64()), pa.array(keys, pa.binary()), pa.array(members, pa.binary())], names=["id", "n", "sid", "keys", "members"])

    return stage(kc.with_counts(dealt, answers, select, schema), "jaccard-sets")


def candidate_links(sets: DataFrame) -> DataFrame:
    """(a, b): each set beside the smallest set id of each of its keys."""

    def unpack(batches):
        for batch in batches:
            sizes = [len(x.as_py()) // 8 for x in batch.column(1)]
            raw = b"".join(x.as_py() for x in batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes), pa.int64()), pa.array(np.frombuffer(raw, "<i8"))], names=["sid", "key"])

    rows = sets.where(F.col("keys").isNotNull()).select("sid", "keys").dropDuplicates(["sid"]).mapInArrow(unpack, "sid long, key long")
    rows = stage(rows, "jaccard-keys")
    hubs = rows.groupBy("key").agg(F.min("sid").alias("hub"), F.max("sid").alias("top")).where("hub <> top").select("key", "hub")
    return rows.join(hubs, "key").where("sid <> hub").select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct()


def meet(members: DataFrame, placed: DataFrame, percent: int, spread: int) -> DataFrame:
    """(a, b): links found where sets meet. placed(sid, root, low, high, tile, label): sets with equal (root, low, high) meet.

    Where low and high differ only sets of different tiles are compared; equal labels are connected already.
    """
    # small meetings are many: some hundred share a task's group, each tile of a large cluster has its own
    place = F.when(F.col("tiled"), F.xxhash64("root", "low", "high")).otherwise(F.pmod(F.xxhash64("root"), F.lit(spread)))
    rows = members.join(small(placed, 100_000), "sid").withColumn("place", place)  # places are narrow, members wide

    def find(group: pa.Table) -> pa.Table:
        a, b = [], []
        names = ("root", "low", "high", "sid", "tile", "label")
        root, low, high, sid, tile, label = (group.column(c).to_pylist() for c in names)
        raw = group.column("members")
        by: dict[tuple, dict[int, int]] = {}
        for i, w in enumerate(zip(root, low, high, strict=True)):
            by.setdefault(w, {})[sid[i]] = i  # a pivot can be there twice
        for (_, x, y), met in by.items():
            own = [met[k] for k in sorted(met)]
            forest, first = Forest(len(own)), {}
            for k, i in enumerate(own):
                forest.join(k, first.setdefault(label[i], k))
            side = np.array([tile[i] == x for i in own]) if x != y else None
            links([np.frombuffer(raw[i].as_py(), np.uint64) for i in own], percent, forest, side)
            for k in range(len(own)):
                if (r := forest.find(k)) != k:
                    a.append(sid[own[k]])
                    b.append(sid[own[r]])
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.select("place", "sid", "root", "tile", "low", "high", "label", "members").groupBy("place").applyInArrow(find, "a long, b long")


def verified_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between set ids, enough to connect what is connected.

    First the sets of a cluster meet; those of a large one in tiles, each with the same few pivots, so that near
    copies of one text are all connected after this step. What then isn't in a large cluster's main component
    meets all other tiles of it.
    """
    clusters = stage(components(candidate_links(sets)).withColumnRenamed("node", "sid"), "jaccard-clusters")
    clustered = small(clusters.select("sid"), 500_000)  # copies of one set alone are in no cluster and stay where they are
    own = sets.where(F.col("members").isNotNull()).join(clustered, "sid", "left_semi")
    members = own.select("sid", "members").dropDuplicates(["sid"])
    weights = own.select("sid", (F.octet_length("members") / 8).cast("long").alias("w")).distinct()
    clusters = clusters.join(weights, "sid")
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"), F.sum("w").alias("weight"))
    clusters = stage(clusters.join(sizes, "root"), "jaccard-clusters")
    weight = clusters.agg(F.sum("w")).first()[0] or 0
    spread = 8 * max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * weight // TILE)  # places of a sixteenth tile, on average
    large = (F.col("weight") > TILE) | (F.col("n") > SETS)
    if not clusters.where(large).take(1):
        placed = clusters.select("sid", "root", F.lit("").alias("low"), F.lit("").alias("high"), F.lit("").alias("tile"), F.col("sid").alias("label"), F.lit(False).alias("tiled"))
        return meet(members, placed, percent, spread)
    members = stage(members, "jaccard-members")
    dealt = lambda n: F.pmod(F.xxhash64("sid", F.lit("tile")), n)
    many = lambda w, n: F.greatest(F.ceil(w / (TILE // 2)), F.ceil(n / (SETS // 2)), F.lit(1)).cast("long")
    tiles = many(F.col("weight"), F.col("n"))
    pivot = large & (F.pmod(F.xxhash64("sid", F.lit("pivot")), F.col("n")) < PIVOTS)
    spots = F.when(pivot, F.sequence(F.lit(0).cast("long"), tiles - 1)).when(large, F.array(dealt(tiles))).otherwise(F.array(F.lit(0).cast("long")))
    placed = clusters.select("sid", "root", large.alias("tiled"), F.explode(spots.cast("array<string>")).alias("tile"))
    first = stage(meet(members, placed.select("sid", "root", F.col("tile").alias("low"), F.col("tile").alias("high"), "tile", F.col("sid").alias("label"), "tiled"), percent, spread), "jaccard-links")

    labels = components(first).withColumnRenamed("node", "sid").withColumnRenamed("root", "label")
    named = clusters.where(large).select("sid", "root", "w").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    named = stage(named, "jaccard-labels")
    main = named.groupBy("root", "label").agg(F.sum("w").alias("m"), F.count("*").alias("k")).groupBy("root").agg(F.max(F.struct("m", "label", "k")).alias("x"), F.sum("m").alias("n"))
    main = main.select("root", F.col("x.label").alias("main"), F.col("x.m").alias("m"), F.col("x.k").alias("k"), (F.col("n") - F.col("x.m")).alias("rest"))
    main = stage(main.where("rest > 0"), "jaccard-rest")
    if not main.take(1):
        return first
    d = named.join(small(main), "root")
    rest, others = many(F.col("rest"), F.lit(1)), many(F.col("m"), F.col("k"))  # what isn't connected meets itself in few large tiles
    apart = F.col("label") != F.col("main")
    tile = F.when(apart, F.concat(F.lit("r"), dealt(rest).cast("string"))).otherwise(F.concat(F.lit("s"), dealt(others).cast("string")))
    every = lambda mark, n: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.concat(F.lit(mark), i.cast("string")))
    meets = F.when(apart, F.concat(every("r", rest), every("s", others))).otherwise(every("r", rest))
    d = d.withColumn("tile", tile).select("sid", "root", "label", "tile", F.explode(meets).alias("other"))
    d = d.select("sid", "root", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "label", F.lit(True).alias("tiled"))
    return first.union(meet(members, d, percent, spread))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    sets = describe(docs, text, key, width, percent)
    roots = components(verified_links(sets.select("sid", "keys", "members"), percent))
    info = sets.select("id", "n", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("node", F.coalesce("root", "sid"))
    info = stage(info.select("id", "n", "node"), "jaccard-nodes")
    least = info.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("m")).where("m > 1").select("node", "least")
    least = stage(least, "jaccard-least")  # so that the join's stage has no aggregate and a hot group can be split
    out = info.join(least, "node", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def op9_ngram_jaccard(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_ngram_jaccard": op9_ngram_jaccard}
#: Every pair of documents that share a shingle, by exact shingles; quadratic in groups of copies, so for small tables.
SQL = {
    "op9_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS g FROM w),
e AS (SELECT r, unnest(g) AS g FROM s),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.r = a JOIN s y ON y.r = b WHERE 100 * n >= 75 * (len(x.g) + len(y.g) - n)),
t AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT r AS a, r AS b FROM s UNION SELECT c.a, t.b FROM c JOIN t ON t.a = c.b)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(min(o.doc_id), s.doc_id) AS component_id FROM s JOIN c ON c.a = s.r JOIN s o ON o.r = c.b GROUP BY s.r, s.doc_id, s.g"""
}
