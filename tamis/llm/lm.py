"""Scores of texts under a trigram model with deleted interpolation.

P(w | u v) mixes the maximum-likelihood estimates of trigram, bigram and unigram and a uniform share. The weights
depend on how often the context was seen: buckets by powers of two of u v's count, or where u v was never seen
of v's. They are learned by expectation maximisation on held-out counts: a tenth of the training documents is
held out, and its events are weighed with the counts of the others. A bucket without events takes the weights of
the nearest that has some.

`score` judges every document by the others: from the counts of all training documents those of the document
itself are deleted before it is scored, as if it were held out. So a text that occurs again in the corpus scores
high, and one that occurs once isn't known by heart. `full_score` is the same sum with nothing deleted; for
documents that the model didn't learn from, both are equal.

Counts come from every training document through keycount; the driver sees a histogram of held-out events
(bucket, estimates rounded to half octaves, unigrams to octaves), whose size is bounded by the resolution
(2 million rows at most, a few ten thousand in practice).

Tokens are words in lower case (A-Z only) and one end; the context of a text's beginning is two ends. Null and
empty texts have the end alone. Without training documents every score is that of the uniform share over one
token, 0. Repeated rows count as often as they occur, and each deletes only its own counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import keycount as kc
from .common import crc_mod, table
from .textkernel import M1, M2, M3, mix, word_hashes

END = np.uint64(0xD6E8FEB86659FD93)
START = mix(np.array([END]) * M1 + np.array([END]) * M2)[0]  #: two ends, the context of a text's first token
CUT = np.uint64(64 - kc.BITS)
STEP = 2.0  #: parts of an octave in the histogram
ADD = 0.1
SEEN = 32  #: buckets from here on are of seen contexts of two words
DEFAULT = {True: (0.4, 0.3, 0.25, 0.05), False: (0.0, 0.4, 0.5, 0.1)}
UNKNOWN = (0.0, 0.0, 0.9, 0.1)


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token and its text's number."""
    words, doc = word_hashes(buf, offsets)
    n = len(offsets) - 1
    each = np.bincount(doc, minlength=n) + 1
    out = np.full(len(words) + n, END, np.uint64)
    out[np.arange(len(words)) + doc] = words
    return out, np.repeat(np.arange(n), each)


def keys(buf: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unigrams, bigrams and trigrams that end at each token."""
    token, doc = tokens(buf, offsets)
    two = np.full(len(token), END, np.uint64)
    two[1:] = token[:-1]  # the token before the first of a text is an end
    pair = mix(two * M1 + token * M2)
    context = np.empty_like(pair)
    context[1:] = pair[:-1]
    context[np.concatenate([[True], doc[1:] != doc[:-1]])] = START
    return [(x >> CUT, doc) for x in (token, pair, mix(context * M1 + token * M3))]


def placed(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token: the place of its key among the distinct ones, and how often its own text has the key."""
    order = np.argsort(key, kind="stable")  # so texts ascend within equal keys
    k, d = key[order], doc[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    run = np.cumsum(new | np.concatenate([[True], d[1:] != d[:-1]])) - 1
    at, own = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    at[order], own[order] = np.cumsum(new) - 1, np.bincount(run)[run]
    return at, own


def bucket(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """By powers of two: of the context of two words where it was seen, else of one; 0 where neither was."""
    octave = lambda x: np.floor(np.log2(np.maximum(x, 1))).astype(np.int64)
    return np.where(two > 0, SEEN + octave(two), np.where(one > 0, 1 + octave(one), 0))


def estimates(counts: list[np.ndarray], start: np.ndarray, total: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, [trigram, bigram, unigram] estimates) of each token; counts of its n-grams; start: whether it begins a text.

    A text's end is its last token and has been seen once for each text, which is how often its beginning was.
    """
    c, two, three = counts
    before, pair = np.empty_like(c), np.empty_like(two)
    before[1:], pair[1:] = c[:-1], two[:-1]
    ends = c[np.append(np.flatnonzero(start)[1:], len(c)) - 1]
    before[start] = pair[start] = ends
    p = np.stack([three / np.maximum(pair, 1), two / np.maximum(before, 1), c / np.maximum(total, 1)], 1)
    return bucket(pair, before), p


def learn(histogram: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (trigram, bigram, unigram, uniform) of each bucket from rows (bucket, levels of the three estimates, events); level 1: zero."""
    h = histogram.astype(np.float64).reshape(-1, 5)
    out = np.array([UNKNOWN if b == 0 else DEFAULT[b >= SEEN] for b in range(2 * SEEN)])
    learned = np.unique(h[:, 0]).astype(int)
    for b in learned:
        own = h[h[:, 0] == b]
        p = np.concatenate([np.where(own[:, 1:4] > 0, 0.0, 2.0 ** (own[:, 1:4] / (STEP, STEP, 1.0))), np.full((len(own), 1), uniform)], 1)
        n, w = own[:, 4], out[b]
        for _ in range(rounds):
            r = p * w
            w = (n[:, None] * r / r.sum(1, keepdims=True)).sum(0) + (w > 0) * 0.5
            w /= w.sum()
        out[b] = w
    for first, last in ((1, SEEN), (SEEN, 2 * SEEN)):
        known = learned[(learned >= first) & (learned < last)]
        for b in range(first, last) if len(known) else ():
            out[b] = out[known[np.argmin(np.abs(known - b))]]
    return out


def score_texts(docs: DataFrame, training, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score, full_score). training: a condition on the rows to count."""
    spark = docs.sparkSession
    shares, bits = kc.layout(docs, text)
    counts = F.coalesce(training, F.lit(False))
    held = counts & (F.pmod(F.xxhash64(F.lit("held"), F.col(key).cast("string")), F.lit(10)) == 0)
    dealt = kc.dealt(docs, key, text, shares, F.when(held, kc.HELD).when(counts, kc.COUNTED).otherwise(kc.ASKING))
    answers = kc.answers(dealt, keys, bits)
    seen = answers.where("s < 0 and kind = 0").agg(F.sum("n"), F.sum("total"), F.sum("apart")).first()
    distinct, total = seen[0] or 0, seen[1] or 0
    others = total - (seen[2] or 0)
    uniform = 1 / (distinct + 1)

    def weigh(cls: int, rows: pa.Table, known) -> pa.RecordBatch:
        made = kc.extracted(rows.column("text"), keys)
        doc = made[0][1]
        own = [(known(k) - known(k, True))[placed(key, doc)[0]] for k, (key, _) in enumerate(made)]
        b, p = estimates(own, np.concatenate([[True], doc[1:] != doc[:-1]]), others)
        level = np.where(p > 0, np.minimum(0, np.round(np.log2(np.maximum(p, 1e-300)) * (STEP, STEP, 1.0))), 1).astype(np.int64) + 1000
        code, n = np.unique(b << 36 | level[:, 0] << 24 | level[:, 1] << 12 | level[:, 2], return_counts=True)
        columns = [code >> 36, *((code >> k & 4095) - 1000 for k in (24, 12, 0))]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(n, pa.int64())], names=["b", "three", "two", "one", "n"])

    found = kc.with_counts(dealt.where(F.col("cls") == kc.HELD), answers.where("held"), weigh, "b int, three int, two int, one int, n long")
    found = found.groupBy("b", "three", "two", "one").agg(F.sum("n").alias("n")).toArrow()
    weights = learn(np.stack([found.column(c).to_numpy() for c in found.column_names], 1), uniform)
    shared = spark.sparkContext.broadcast(weights)
    schema = f"key {docs.schema[key].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, full_score double"

    def score(cls: int, rows: pa.Table, known) -> pa.RecordBatch:
        made, n = kc.extracted(rows.column("text"), keys), rows.num_rows
        doc = made[0][1]
        start = np.concatenate([[True], doc[1:] != doc[:-1]])
        places = [placed(key, doc) for key, _ in made]
        full = [known(k)[at] for k, (at, _) in enumerate(places)]
        each = np.bincount(doc, minlength=n)

        def logs(counts: list[np.ndarray], of: np.ndarray | float) -> np.ndarray:
            b, p = estimates(counts, start, of)
            w = shared.value[b]
            mixed = (w[:, :3] * p).sum(1) + w[:, 3] * uniform
            return np.bincount(doc, np.log10(np.where(np.asarray(of) > 0, mixed, uniform)), n)

        whole = logs(full, total)
        rest = whole if cls == kc.ASKING else logs([c - own for c, (_, own) in zip(full, places, strict=True)], (total - each)[doc])
        base = np.bincount(doc, np.log10((full[0] + ADD) / (total + ADD * (distinct + 1))), n)
        columns = [pa.array(each, pa.int64()), pa.array(np.bincount(doc, full[0] > 0, n).astype(np.int64)), pa.array(np.full(n, total), pa.int64()), *(pa.array(x, pa.float64()) for x in (base, rest, whole))]
        return pa.RecordBatch.from_arrays([rows.column("id").combine_chunks(), *columns], names=["key", "n_tokens", "n_known", "train_tokens", "base_score", "score", "full_score"])

    return kc.with_counts(dealt, answers, score, schema).withColumnRenamed("key", key)


def op8_lm_scoring(spark, sf_dir):
    out = score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) != 0)
    return out.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "full_score")


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
SQL: dict[str, str] = {}
