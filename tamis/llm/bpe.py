"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token in one probe and one
comparison. Tier two: a miss is merged bottom up, with a heap of pair ranks over linked bytes (lowest rank
first, leftmost on ties), which takes n log n steps however long the pre-token is.

Pre-tokens that have been encoded are kept in a bounded memo per worker, as words repeat. Null is the empty
text: no tokens, the hashes of nothing. Texts of more than PIECE characters are hashed piece by piece, so
that memory doesn't follow the length of the ids' text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

MEMO = 250_000  #: pre-tokens kept per worker and generation
PIECE = 1 << 20
ODD1, ODD2, ALL = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 2**64 - 1
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class PerfectHash:
    """Hash and displace: n keys to n slots without holes. Buckets of one key name their slot outright."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.m = n, max(1, n // 3)
        self.shift = np.zeros(self.m, np.int64)
        self.slots = np.full(n, -1, np.int64)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, n)
        bucket = (h % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(self.m + 1))
        size = np.diff(cut)
        for k in np.argsort(-size, kind="stable"):
            own = order[cut[k] : cut[k + 1]]
            if len(own) < 2:
                break
            first = 0
            while True:  # try displacements, a block at a time
                d = np.arange(first, first + 64, dtype=np.uint64)
                at = ((((h[own][None, :] ^ d[:, None] * np.uint64(ODD1)) * np.uint64(ODD2)) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
                free = (self.slots[at] < 0).all(1)
                for j in np.flatnonzero(free):
                    if len(np.unique(at[j])) == len(own):
                        break
                else:
                    first += 64
                    if first > 100 * n:
                        raise ValueError("two keys share a hash")
                    continue
                self.shift[k], self.slots[at[j]] = int(d[j]), own
                break
        rest = iter(np.flatnonzero(self.slots < 0))
        for k in np.flatnonzero(size == 1):
            s = next(rest)
            self.shift[k], self.slots[s] = -1 - s, order[cut[k]]
        self._shift, self._slots, self._keys = self.shift.tolist(), self.slots.tolist(), keys

    def find(self, key: bytes) -> int:
        """Number of the key in the list it was built from, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self._shift[h % self.m]
        k = self._slots[-1 - d if d < 0 else ((((h ^ (d * ODD1 & ALL)) * ODD2) & ALL) >> 32) % self.n]
        return k if self._keys[k] == key else -1


class Memo(dict):
    """What `of` gave for recent pre-tokens: two generations of at most MEMO each, so common ones stay."""

    def __init__(self, of):
        self.of, self.old = of, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        got = self.old.get(piece) or self.of(piece)
        if len(piece) < 100:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


class ByteBpe:
    """Encoder and decoder over ranks {token bytes: id}."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self._set(ranks, pattern, PerfectHash(list(ranks)))

    def _set(self, ranks: dict[bytes, int], pattern: str, whole: PerfectHash) -> None:
        self.ranks, self.pattern, self.whole = ranks, regex.compile(pattern), whole
        self.ids = list(ranks.values())
        size = max(self.ids, default=-1) + 1
        self.token, self.text = [b""] * size, [str(i) for i in range(size)]
        for k, i in ranks.items():
            self.token[i] = k
        self.memo = Memo(self.of)

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-token that isn't a token itself."""
        n, ranks = len(word), self.ranks
        end = list(range(1, n + 1))  # of the part that starts here; 0: merged into an earlier part
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:  # one of the two parts has changed since
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return tuple(out)

    def of(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        k = self.whole.find(raw)
        return (self.ids[k],) if k >= 0 else self.merge(raw)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pattern.findall(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def pieces(self, text: str):
        """Ids of the text, in lists of the ids of many pre-tokens."""
        if len(text) <= PIECE:
            yield self.encode(text)
            return
        found = (m[0] for m in self.pattern.finditer(text))
        while part := list(islice(found, 50_000)):
            yield list(chain.from_iterable(map(self.memo.__getitem__, part)))

    def digest(self, text: str, keep: list[np.ndarray] | None = None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of their decimal text, SHA-256 of what they decode to. The ids themselves go to keep."""
        n, a, b = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.pieces(text):
            a.update((("," if n and ids else "") + ",".join(map(self.text.__getitem__, ids))).encode())
            b.update(self.decode(ids))
            n += len(ids)
            if keep is not None:
                keep.append(np.array(ids, np.int32))
        return n, a.hexdigest(), b.hexdigest()


    def __getstate__(self):
        return self.ranks, self.pattern.pattern, self.whole

    def __setstate__(self, state):
        ranks, pattern, whole = state
        self._set(ranks, pattern, whole)


_loaded: dict[str, ByteBpe] = {}
_shared: dict[tuple[str, str], Broadcast] = {}


def _broadcast(spark: SparkSession, path: str) -> Broadcast:
    """The encoder with its tables, built once on the driver: some 2 MB, whatever the data."""
    at = (spark.sparkContext.applicationId, path)
    if at not in _shared:
        _loaded.setdefault(path, ByteBpe.load(path))
        _shared[at] = spark.sparkContext.broadcast(_loaded[path])
    return _shared[at]


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) and, with keep_ids, ids array<int>. path: a rank file that the driver reads."""
    small_batches(docs.sparkSession)
    shared = _broadcast(docs.sparkSession, path or public_tokenizers.path(VOCABULARY))
    narrow = docs.select(key, text)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches):
        bpe = shared.value
        for batch in batches:
            got, ids, ends = [], [], [0]
            for s in batch.column(1):
                got.append(bpe.digest(s.as_py() or "", ids if keep_ids else None))
                ends.append(ends[-1] + got[-1][0])
            n, a, b = zip(*got, strict=True) if got else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    return narrow.mapInArrow(run, schema)


def op6_byte_bpe(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), keep_ids=False)


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
SQL: dict[str, str] = {}
