"""Counts of hashed keys over all documents, handed back to the documents that have them.

Counting n-grams and giving every document its counts are two large exchanges if done row by row. Here keys
travel as packed sorted arrays. Documents are dealt to shares by a hash and sorted by (class, hash) within them;
a share's stream of documents is cut into segments, in the same places whenever it is read. Each segment sends
its distinct keys, sorted, with less than 5 bytes a key, to the ranges that count them. A range sums all its keys and
answers every request with the counts in the order of its keys, most of them 1, so answers pack to almost
nothing. When the share is streamed again, its answers come first, and each segment makes the same sorted keys
and so knows the count of each. Nothing is collected on the driver. A task holds one segment or one range at a
time and the packed answers of a share, however many documents, or equal ones, there are.

Requests and answers are one row for each share (more where shares are large) and range, never more than one a
key. Shares and ranges grow with the input, as far as the memory of executors goes.

Keys have 53 bits here: of 10**12 different keys about one in 9,000 shares its count with another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage
from .textkernel import slabs

BITS = 53
SEGMENT_BYTES, SEGMENT_DOCS = 5_000_000, 60_000
SHARE_BYTES, RANGE_BYTES = 18_000_000, 12_000_000
LEAST_PARTS = 48  #: shares of small inputs, at most
CHUNK_KEYS = 4_000_000
REQUEST = "p int, s int, segments binary, sizes binary, heads binary, plain int, steps array<binary>, counts binary"
ANSWER = "s int, held boolean, kind int, p int, n long, total long, apart long, segments binary, sizes binary, counts binary, minus binary"
#: Classes of documents: counted, counted and held out for weights, only asking. Answers come before them.
COUNTED, HELD, ASKING, ANSWERS = 0, 1, 2, -1

#: Keys of each kind, and the number of the text that each is from.
Extractor = Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]


def room(docs: DataFrame) -> float:
    """How many times the memory of the smallest executors (1.8 GB of heap) those of this session have."""
    text = docs.sparkSession.sparkContext.getConf().get("spark.executor.memory", "1g").lower()
    unit = {"k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}.get(text.rstrip("b")[-1:], 1)
    return min(16.0, max(1.0, float(text.rstrip("bkmgt") or 1) * unit / 1.8e9))


def layout(docs: DataFrame, text: str) -> tuple[int, int]:
    """(shares of documents, bits of key ranges), by the bytes of text."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = min(LEAST_PARTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    times = max(1.0, (size / 1e9) ** 0.5)  # larger shares and ranges where there would be very many answers
    own, by = SHARE_BYTES * min(times, 8.0 * room(docs)), RANGE_BYTES * min(times, 3.0 * room(docs))
    return max(parts, int(size / own) + 1), max(3, min(24, max(parts // 2, int(size / by) + 1).bit_length()))


def dealt(docs: DataFrame, key: str, text: str, shares: int, kind: Column | int) -> DataFrame:
    """(s, cls, h, text, id): rows by share, class and a hash of id and text."""
    h = F.xxhash64(F.col(key).cast("string"), F.col(text))
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return docs.select(F.pmod(h, F.lit(shares)).cast("int").alias("s"), kind.cast("int").alias("cls"), h.alias("h"), F.col(text).alias("text"), F.col(key).alias("id"))


def planes(x: np.ndarray) -> bytes:
    """Packed counts: the bytes of all numbers by weight."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def split(steps: np.ndarray) -> tuple[int, list[bytes]]:
    """Steps between keys as planes of bytes: how many low ones are as good as random, and all, the others packed."""
    if not len(steps):
        return 0, []
    plain = max(0, int(np.log2(max(1.0, float(steps.mean())))) // 8)
    width = max(1, plain, (int(steps.max()).bit_length() + 7) // 8)
    wide = steps.view(np.uint8).reshape(-1, 8)
    each = (np.ascontiguousarray(wide[:, k]).tobytes() for k in range(width))
    return plain, [x if k < plain else zstandard.ZstdCompressor(level=1).compress(x) for k, x in enumerate(each)]


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.Table]]:
    """(share, class, number within both, rows) of each segment; answers as they come. Batches begin with s, cls and text.

    A segment ends with the row that fills it, so batches' sizes don't matter.
    """
    held: list[pa.RecordBatch] = []
    now, size, rows, number = None, 0, 0, 0

    def done() -> tuple[int, int, int, pa.Table]:
        return now >> 3, (now & 7) - 1, number, pa.Table.from_batches(held).combine_chunks()

    for batch in batches:
        code = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) << 3 | batch.column(1).to_numpy(zero_copy_only=False) + 1
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i, n = 0, batch.num_rows
        while i < n:
            if code[i] != now:
                if held:
                    yield done()
                held, now, size, rows, number = [], int(code[i]), 0, 0, 0
            same = code[i:] != now
            end = i + (int(np.argmax(same)) if same.any() else n - i)
            if not now & 7:
                yield now >> 3, ANSWERS, 0, pa.Table.from_batches([batch.slice(i, end - i)])
                i = end
                continue
            before = int(total[i - 1]) if i else 0
            full = int(np.searchsorted(total, before + SEGMENT_BYTES - size)) + 1  # rows up to this one fill it
            j = min(end, full, i + SEGMENT_DOCS - rows)
            held.append(batch.slice(i, j - i))
            size, rows = size + int(total[j - 1]) - before, rows + j - i
            if size >= SEGMENT_BYTES or rows >= SEGMENT_DOCS:
                yield done()
                held, size, rows, number = [], 0, 0, number + 1
            i = j
    if held:
        yield done()


def extracted(text: pa.ChunkedArray | pa.Array, extract: Extractor) -> list[tuple[np.ndarray, np.ndarray]]:
    """All keys of a segment by kind, with their texts' numbers."""
    column = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    parts, base = [], 0
    for _, buf, offsets in slabs(column):
        parts.append([(key, doc + base) for key, doc in extract(buf, offsets)])
        base += len(offsets) - 1
    return [tuple(np.concatenate(x) for x in zip(*kind, strict=True)) for kind in zip(*parts, strict=True)]


def _pack(s: int, kind: int, parts: list[tuple[int, np.ndarray, np.ndarray]], bits: int) -> pa.RecordBatch | None:
    """One row a range: (segment code, sorted distinct keys, counts) of some segments."""
    parts = [x for x in parts if len(x[1])]
    if not parts:
        return None
    low = np.uint64(BITS - bits)
    key, count = (np.concatenate([x[i] for x in parts]) for i in (1, 2))
    part = (key >> low).astype(np.int64)
    segment = np.repeat(np.arange(len(parts)), [len(x[1]) for x in parts])
    order = np.argsort(part, kind="stable")  # range, segment, key
    part, segment, count = part[order], segment[order], count[order]
    value = key[order] & np.uint64((1 << int(low)) - 1)
    new = np.concatenate([[True], (part[1:] != part[:-1]) | (segment[1:] != segment[:-1])])
    rows, codes = [], np.array([x[0] for x in parts], "<i8")
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, b in zip(cuts, np.append(cuts[1:], len(part)), strict=True):
        head = np.flatnonzero(new[a:b])
        v = value[a:b]
        steps = np.delete(np.diff(v, prepend=v[:1]), head)
        plain, planes_ = split(steps)
        rows.append((
            kind << bits | int(part[a]), s, codes[segment[a:b][head]].tobytes(), np.diff(head, append=b - a).astype("<u4").tobytes(), v[head].tobytes(),
            plain, planes_, planes(count[a:b]),
        ))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["p", "s", "segments", "sizes", "heads", "plain", "steps", "counts"])


def _unpack(sizes: bytes, heads: bytes, plain: int, steps: list[bytes]) -> np.ndarray:
    """Low key bits of each key."""
    size = np.frombuffer(sizes, "<u4").astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    wide = np.zeros((int(size.sum()) - len(size), 8), np.uint8)
    for k, raw in enumerate(steps):
        wide[:, k] = np.frombuffer(raw if k < plain else zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    value = np.zeros(int(size.sum()), np.uint64)
    rest = np.ones(len(value), bool)
    rest[first] = False
    value[rest] = wide.view(np.uint64).ravel()
    run = np.cumsum(value, dtype=np.uint64)
    return run - np.repeat(run[first], size) + np.repeat(np.frombuffer(heads, np.uint64), size)


def ordered(docs: DataFrame) -> DataFrame:
    return docs.repartition("s").sortWithinPartitions("s", "cls", "h")


def answers(docs: DataFrame, extract: Extractor, bits: int) -> DataFrame:
    """For dealt docs: the staged table of answers, and rows with s = -1 that have the distinct counted keys (n), their total, and that of the held (apart)."""

    def ask(batches):
        parts: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        many, of = 0, -1

        def flush():
            for kind in sorted(parts):
                if (out := _pack(of, kind, parts[kind], bits)) is not None:
                    yield out

        for s, cls, number, rows in streamed(batches):
            if parts and (s != of or many >= CHUNK_KEYS):
                yield from flush()
                parts, many = {}, 0
            of = s
            for kind, (key, _) in enumerate(extracted(rows.column("text"), extract)):
                key, count = np.unique(key, return_counts=True)
                parts.setdefault(kind, []).append((cls << 40 | number, key, count))
                many += len(key)
        yield from flush()

    def answer(name, table):
        p = name[0].as_py()
        rows = [{c: table.column(c)[i].as_py() for c in ("s", "segments", "sizes", "heads", "plain", "steps", "counts")} for i in range(table.num_rows)]
        parts = [_unpack(r["sizes"], r["heads"], r["plain"], r["steps"]) for r in rows]
        each = [np.frombuffer(r["sizes"], "<u4").astype(np.int64) for r in rows]
        count = np.concatenate([numbers(r["counts"]) for r in rows]).astype(np.int64)
        kind = np.concatenate([np.repeat(np.frombuffer(r["segments"], "<i8") >> 40, size) for r, size in zip(rows, each, strict=True)])
        value, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        del parts
        order = np.argsort(value)
        value = value[order]
        rank = np.empty(len(value), np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], value[1:] != value[:-1]]))
        del order, value
        counted = np.bincount(rank, count * (kind != ASKING)).astype(np.int64)
        out = [(-1, False, p >> bits, p & (1 << bits) - 1, int((counted > 0).sum()), int(counted.sum()), int(count[kind == HELD].sum()), None, None, None, None)]
        held = np.bincount(rank, count * (kind == HELD)).astype(np.int64) if (kind == HELD).any() else None
        for i, r in enumerate(rows):
            at = rank[ends[i] - int(each[i].sum()) : ends[i]]
            codes = np.frombuffer(r["segments"], "<i8")
            apart = codes >> 40 == HELD
            for of_held in (False, True):
                own = apart == of_held
                if own.any():
                    chosen = at[np.repeat(own, each[i])] if not own.all() else at
                    out.append((r["s"], of_held, p >> bits, p & (1 << bits) - 1, len(chosen), 0, 0, codes[own].tobytes(), each[i][own].astype("<u4").tobytes(), planes(counted[chosen]), planes(held[chosen]) if of_held else None))
        kinds = (pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["s", "held", "kind", "p", "n", "total", "apart", "segments", "sizes", "counts", "minus"])

    return stage(ordered(docs).select("s", "cls", "text").mapInArrow(ask, REQUEST).groupBy("p").applyInArrow(answer, ANSWER), "key-answers")


class Answers:
    """The answers of one share: counts of each segment's distinct keys, in the order of the keys."""

    def __init__(self):
        self.by: dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray | None]]] = {}

    def add(self, rows: pa.Table) -> None:
        for r in rows.select(["kind", "p", "segments", "sizes", "counts", "minus"]).to_pylist():
            size = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
            count, minus = numbers(r["counts"]), numbers(r["minus"]) if r["minus"] is not None else None
            for code, b, n in zip(np.frombuffer(r["segments"], "<i8").tolist(), np.cumsum(size).tolist(), size.tolist(), strict=True):
                self.by.setdefault((code, r["kind"]), []).append((r["p"], count[b - n : b], minus[b - n : b] if minus is not None else None))

    def of(self, cls: int, number: int, kind: int, held: bool = False) -> np.ndarray:
        found = sorted(self.by.get((cls << 40 | number, kind), ()), key=lambda x: x[0])
        return np.concatenate([x[2 if held else 1] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64)


def with_counts(docs: DataFrame, answers: DataFrame, use: Callable[[int, pa.Table, Callable[..., np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """use(class, rows (text, id), counts) for each segment of dealt docs; counts(kind, held=False) are those of its distinct keys."""
    kind = docs.schema["id"].dataType
    extra = ("kind", "p", "segments", "sizes", "counts", "minus")
    none = [F.lit(None).cast(answers.schema[c].dataType).alias(c) for c in extra]
    left = docs.select("s", "cls", "text", "h", "id", *none)
    right = answers.where("s >= 0").select("s", F.lit(ANSWERS).alias("cls"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("h"), F.lit(None).cast(kind).alias("id"), *extra)

    def run(batches):
        of, known = None, Answers()
        for s, cls, number, rows in streamed(batches):
            if s != of:
                of, known = s, Answers()
            if cls == ANSWERS:
                known.add(rows)
            else:
                yield use(cls, rows.select(["text", "id"]), lambda kind, held=False: known.of(cls, number, kind, held))  # noqa: B023

    return ordered(left.unionByName(right)).mapInArrow(run, schema)
