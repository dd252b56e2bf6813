"""Words and their 64-bit hashes over whole Arrow batches, in numpy: nothing here runs per word in Python.

Words are compared by a 64-bit hash. Two different words share one with probability 2**-64 each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)
#: Longer words go through xxhash one by one, so that one endless word doesn't set the number of rounds for all.
LONG = 512


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def slabs(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) for runs of texts of about `most` bytes together; null is empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i]).astype(np.int64)
        i = j


def bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; no word goes over the end of its text."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    solid = ~SPACE[buf]
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    after[-1], after[:-1] = False, solid[1:]
    edge = offsets[1:-1]
    before[edge[edge < len(buf)]] = False
    after[edge[edge > 0] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, eight bytes a round."""
    wide = np.lib.stride_tricks.as_strided(padded := np.concatenate([buf, np.zeros(8, np.uint8)]).view(), (len(buf) + 1, 8), (1, 1))
    size = (ends - starts).astype(np.int64)
    h = size.astype(np.uint64) * M1
    at, left, who = starts, size, None
    if len(big := np.flatnonzero(size > LONG)):
        raw = padded.tobytes()
        out = np.fromiter((xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]]) for i in big), np.uint64, len(big))
        left = np.where(size > LONG, 0, size)
        h[big] = out
    while True:
        alive = left > 0
        if not alive.all():
            keep = np.flatnonzero(alive)
            who = keep if who is None else who[keep]
            at, left = at[keep], left[keep]
        if not len(at):
            return mix(h)
        x = np.ascontiguousarray(wide[at]).view(np.uint64)[:, 0] & _MASK[np.minimum(left, 8)]
        if who is None:
            h = (h ^ x) * M2
            h ^= h >> np.uint64(29)
        else:
            y = (h[who] ^ x) * M2
            h[who] = y ^ (y >> np.uint64(29))
        at, left = at + 8, left - 8


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the text number of each."""
    low = LOWER[buf]
    starts, ends, doc = bounds(low, offsets)
    return hashes(low, starts, ends), doc
