"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte trigrams of lower-cased letters. For each document, expectation
maximisation estimates the proportions of the languages in it; then nested sets of the largest ones are
refitted, and the set with the best likelihood less a penalty for each language is kept. The prediction is
the largest language of that set, its score that language's proportion.

The trigram counts are fitted on a bounded sample of labelled documents: about PER_LANGUAGE of each of the
LANGUAGES most frequent languages, by a hash of the id. Prediction covers every document and the whole text.

Null texts and texts without letters are `und` with score 0. Ties go to the language first by code point.
Without training documents every prediction is `und`. Null languages are not learned from.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_batches, table

BITS = 13
PER_LANGUAGE, LANGUAGES = 2000, 1000
ROUNDS, PENALTY = 12, 6.0
LETTER = re.compile(r"[^\W\d_]")
_KEEP = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """Counts of hashed trigrams; what isn't a letter counts as a space, and no trigram has two spaces in a row."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass").translate(_KEEP), np.uint8)
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])].astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(1 << BITS, np.int64)
    h = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA77)) ^ (raw[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)


class Mixture:
    """names, and rows of trigram probabilities for each."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts + 0.5
        self.p = np.ascontiguousarray((smooth / smooth.sum(1, keepdims=True)).T) if names else np.zeros((1 << BITS, 0))

    @staticmethod
    def fit(p: np.ndarray, c: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood of trigrams with counts c and probabilities p[trigram, language]."""
        total = c.sum()
        for _ in range(rounds):
            share = share * (p.T @ (c / (p @ share))) / total
        return share, float(c @ np.log(p @ share))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not LETTER.search(text):
            return "und", 0.0
        counts = grams(text)
        seen = np.flatnonzero(counts)
        if not len(seen):
            return "und", 0.0
        c, p = counts[seen].astype(np.float64), self.p[seen]
        n = len(self.names)
        share, _ = self.fit(p, c, np.full(n, 1 / n), ROUNDS)
        order = np.argsort(-share, kind="stable")
        best = None
        for k in range(1, n + 1):
            if k > 1 and share[order[k - 1]] * c.sum() < 1:
                break
            own = order[:k]
            part, like = (np.ones(1), float(c @ np.log(p[:, own[0]]))) if k == 1 else self.fit(p[:, own], c, share[own] / share[own].sum(), ROUNDS // 2)
            like -= PENALTY * k * max(1.0, np.log(c.sum()) / 4)
            if best is None or like > best[0]:
                best = like, own, part
            elif k > 2:
                break
        _, own, part = best
        top = int(np.argmax(part))
        return self.names[own[top]], float(min(1.0, part[top]))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Mixture:
    """Fit on about per_language documents of each language; docs: labelled documents only."""
    docs = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in docs.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(LANGUAGES).collect()}
    if not sizes:
        return Mixture([], np.zeros((0, 1 << BITS)))
    draw = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit("langid")), 11) / F.lit(2.0**53)
    chance = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))))
    sample = docs.where(draw < F.coalesce(chance[F.col(lang)], F.lit(0.0))).select(lang, text).repartition(16)

    def count(batches):
        got: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got[name] = got.get(name, 0) + grams(s.as_py())
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array([x.astype("<i8").tobytes() for x in got.values()], pa.binary())], names=["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    for name, raw in sample.mapInArrow(count, "lang string, counts binary").collect():
        total[name] = total.get(name, 0) + np.frombuffer(raw, "<i8")
    names = sorted(total)
    return Mixture(names, np.array([total[n] for n in names]).reshape(len(names), 1 << BITS))


def identify(docs: DataFrame, model: Mixture, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., lang_pred, score. Columns of these names are replaced."""
    keep = tuple(c for c in keep if c not in ("lang_pred", "score") or c == text)
    small_batches(docs.sparkSession)
    at = keep.index(text) if text in keep else len(keep)
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.p.astype(np.float32)))  # 32 KB a language
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + "lang_pred string, score double"

    def run(batches):
        names, p = shared.value
        own = Mixture(names, np.ones((len(names), 1 << BITS)))
        own.p = p.astype(np.float64)
        for batch in batches:
            got = [own.predict(s.as_py()) for s in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, *[text][at < len(keep) :]).mapInArrow(run, schema)


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_mod("doc_id", 3) != 1))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
SQL: dict[str, str] = {}
