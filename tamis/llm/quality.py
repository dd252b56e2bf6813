"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages: its words in runs of PASSAGE. Every passage is encoded (hashed character
bigrams, shapes of words, repetition) and put through a learned layer; gated attention (a tanh branch times a
sigmoid branch) gives each passage a weight within its document, and the weighted mean of the encoded passages
is scored. Only documents have labels; which passages matter is learned from them.

The model is fitted on the driver with a bounded sample: at most SAMPLE labelled documents by a hash of the
id, and of each at most LEARNED passages, spread evenly over the whole text, in half precision. The driver so
receives at most SAMPLE * LEARNED * 224 bytes (86 MB). Scoring reads every passage of every document.

Null texts and texts without words are one passage of zeros and get that passage's score. Null labels are not
learned from; of several labels for an id the largest counts. With labels of one value only, or none, every
score is their mean (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_batches, table
from .textkernel import bounds, hashes, slabs

PASSAGE = 48
BUCKETS = 96
SAMPLE, LEARNED = 6000, 64
HIDDEN, GATE = 24, 12
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 symbol, 7 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9, 10, 11, 12, 13]] = 1, 2, 3, 4
_CLASS[list(b".,;:'\"-()?")], _CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")], _CLASS[128:] = 5, 6, 7
WIDTH = 8 + 8 + BUCKETS


def encode(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and the text number of each; every text has a passage at least."""
    n = len(offsets) - 1
    starts, ends, doc = bounds(buf, offsets)
    words = np.bincount(doc, minlength=n)
    each = np.maximum(1, -(-words // PASSAGE))
    base = np.concatenate([[0], np.cumsum(each)])
    total = int(base[-1])
    out = np.zeros((total, WIDTH), np.float32)
    owner = np.repeat(np.arange(n), each)
    if not len(starts):
        return out, owner
    first = np.concatenate([[0], np.cumsum(words)])
    within = np.arange(len(starts)) - first[doc]
    passage = base[doc] + within // PASSAGE
    # the passage of each byte: from a passage's first word up to the next passage's
    head = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    cuts = starts[head]
    of = np.repeat(passage[head], np.diff(np.concatenate([cuts, [len(buf)]])))
    text = buf[cuts[0] :]
    kind = _CLASS[text]
    size = np.bincount(of, minlength=total).astype(np.float32)
    classes = np.bincount(of * 8 + kind, minlength=total * 8).reshape(total, 8)
    out[:, :8] = classes / np.maximum(size, 1)[:, None]
    low = text | np.where(kind == 2, 32, 0).astype(np.uint8)
    pair = (low[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) ^ low[1:].astype(np.uint32) * np.uint32(0x85EBCA77)) * np.uint32(0x2C1B3C6D) >> np.uint32(20)
    counts = np.bincount(of[:-1] * BUCKETS + pair % BUCKETS, minlength=total * BUCKETS).reshape(total, BUCKETS)
    out[:, 16:] = np.sqrt(counts / np.maximum(size, 1)[:, None])
    number = np.bincount(passage, minlength=total).astype(np.float32)
    full = np.maximum(number, 1)
    h = hashes(buf, starts, ends)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((h, passage))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])])
    length = (ends - starts).astype(np.float32)
    out[:, 8] = np.bincount(passage, same, total) / full
    out[:, 9] = np.bincount(passage[order], new, total) / full
    out[:, 10] = np.bincount(passage, length, total) / full / 10
    out[:, 11] = np.bincount(passage, kind[starts - cuts[0]] == 2, total) / full
    out[:, 12] = np.bincount(passage, kind[starts - cuts[0]] == 6, total) / full
    out[:, 13] = np.bincount(passage, kind[ends - 1 - cuts[0]] == 6, total) / full
    out[:, 14] = np.bincount(passage, kind[ends - 1 - cuts[0]] == 5, total) / full
    out[:, 15] = number / PASSAGE
    return out, owner


class Attention:
    """Gated attention pooling over encoded passages, in plain numpy."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, tuple]:
        w = self.w
        h = np.tanh(((x - w["mean"]) / w["scale"]) @ w["E"] + w["e"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (t * s) @ w["a"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, owner, a)
        a = np.exp(a - top[owner])
        a /= np.bincount(owner, a, n)[owner]
        z = np.stack([np.bincount(owner, a * h[:, k], n) for k in range(h.shape[1])], 1)
        score = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
        return score, (h, t, s, a, z)

    def step(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss."""
        w, n = self.w, len(y)
        score, (h, t, s, a, z) = self.forward(x, owner, n)
        d = (score - y) / n
        dz = d[:, None] * w["c"]
        dh = a[:, None] * dz[owner]
        da = (dz[owner] * h).sum(1)
        da = a * (da - np.bincount(owner, a * da, n)[owner])
        dt, ds = da[:, None] * w["a"] * s * (1 - t**2), da[:, None] * w["a"] * t * s * (1 - s)
        dh += dt @ w["V"].T + ds @ w["U"].T
        du = dh * (1 - h**2)
        xs = (x - w["mean"]) / w["scale"]
        return {"E": xs.T @ du, "e": du.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": ((t * s) * da[:, None]).sum(0), "c": z.T @ d, "b": np.array([d.sum()])}

    @classmethod
    def fit(cls, bags: list[np.ndarray], y: np.ndarray, epochs: int = 14, seed: int = 3) -> Attention:
        rng = np.random.default_rng(seed)
        every = np.concatenate(bags)
        w = {"mean": every.mean(0), "scale": every.std(0) + 0.02, "e": np.zeros(HIDDEN), "b": np.zeros(1)}
        for k, shape in {"E": (WIDTH, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,)}.items():
            w[k] = rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        model, m, v, t = cls(w), {}, {}, 0
        for epoch in range(epochs):
            rate = 0.01 * (0.5 if epoch > epochs * 0.6 else 1) * (0.3 if epoch > epochs * 0.85 else 1)
            order = rng.permutation(len(bags))
            for i in range(0, len(order), 64):
                own = order[i : i + 64]
                x, owner = np.concatenate([bags[k] for k in own]), np.repeat(np.arange(len(own)), [len(bags[k]) for k in own])
                t += 1
                for k, g in model.step(x, owner, y[own]).items():
                    g = g + 1e-4 * w[k]
                    m[k], v[k] = 0.9 * m.get(k, 0) + 0.1 * g, 0.999 * v.get(k, 0) + 0.001 * g**2
                    w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Attention | float:
    """Fit on at most SAMPLE documents that have a label; one value of label only gives that mean instead."""
    small_batches(docs.sparkSession)
    draw = F.xxhash64(F.col(key).cast("string"), F.lit("quality"))
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_y")).orderBy(draw, key).limit(SAMPLE)
    rows = docs.select(key, text).join(F.broadcast(chosen), key).repartition(12, F.col(key))

    def run(batches):
        for batch in batches:
            y = batch.column(2).to_pylist()
            for i, buf, offsets in slabs(batch.column(1)):
                x, owner = encode(buf, offsets)
                cut = np.searchsorted(owner, np.arange(len(offsets)))
                bags = [x[a + np.unique(np.arange(LEARNED) * (b - a) // LEARNED)] for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(offsets) - 1).cast(pa.string()), pa.array(y[i : i + len(offsets) - 1], pa.float64()), pa.array([b.astype(np.float16).tobytes() for b in bags], pa.binary())], names=["k", "y", "x"])

    got = sorted(tuple(r) for r in rows.select(key, text, F.col("_y").cast("double")).mapInArrow(run, "k string, y double, x binary").collect())
    y = np.array([r[1] for r in got])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return Attention.fit([np.frombuffer(r[2], np.float16).astype(np.float32).reshape(-1, WIDTH) for r in got], y)


def score(docs: DataFrame, model: Attention | float, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., score. A column of that name is replaced."""
    keep = tuple(c for c in keep if c != "score" or c == text)
    small_batches(docs.sparkSession)
    at = keep.index(text) if text in keep else len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 30 KB
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + "score double"

    def run(batches):
        own = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if isinstance(own, float):
                out[:] = own
            else:
                for i, buf, offsets in slabs(batch.column(at), 1 << 20):
                    x, owner = encode(buf, offsets)
                    out[i : i + len(offsets) - 1] = own.forward(x, owner, len(offsets) - 1)[0]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out)], names=[*keep, "score"])

    return docs.select(*keep, *[text][at < len(keep) :]).mapInArrow(run, schema)


def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
SQL: dict[str, str] = {}
