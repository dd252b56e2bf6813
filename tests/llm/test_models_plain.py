"""The fitted models' scores by plain loops over their definition; long texts; and what training is bounded by."""

import math

import numpy as np
import pytest

from tamis.llm import htmltext, jaccard, langid, lm, quality, textkernel
from tamis.llm.keycount import extracted

ENGLISH = "the quick brown fox jumps over the lazy dog and then some more of the words that people write every day "
GERMAN = "der schnelle braune fuchs springt über den faulen hund und noch einige wörter die leute jeden tag schreiben "
SPANISH = "el rápido zorro marrón salta sobre el perro perezoso y algunas palabras más que la gente escribe cada día "


def plain_grams(text):
    kept = "".join(c if c.isascii() and c.islower() else c if ord(c) >= 128 else " " for c in f" {text.lower()} ")
    raw = kept.encode()
    raw = bytes(b for i, b in enumerate(raw) if i == 0 or b != 32 or raw[i - 1] != 32)
    out = {}
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        h = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF) ^ (c * 0xC2B2AE3D & 0xFFFFFFFF)
        h = ((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 32 - langid.BITS
        out[h] = out.get(h, 0) + 1
    return out


def plain_mixture(trained, text):
    """(language, proportion) by expectation maximisation in loops; trained: {language: {trigram: count}}."""
    size = 1 << langid.BITS
    names, counts = sorted(trained), plain_grams(text)
    p = {n: {g: (trained[n].get(g, 0) + 0.5) / (sum(trained[n].values()) + 0.5 * size) for g in counts} for n in names}
    total = sum(counts.values())

    def fit(own, share, rounds):
        for _ in range(rounds):
            mixed = {g: sum(share[n] * p[n][g] for n in own) for g in counts}
            share = {n: share[n] * sum(c * p[n][g] / mixed[g] for g, c in counts.items()) / total for n in own}
        return share, sum(c * math.log(sum(share[n] * p[n][g] for n in own)) for g, c in counts.items())

    share, _ = fit(names, {n: 1 / len(names) for n in names}, langid.ROUNDS)
    order, best = sorted(names, key=lambda n: -share[n]), None
    for k in range(1, len(names) + 1):
        if k > 1 and share[order[k - 1]] * total < 1:
            break
        own = order[:k]
        part, like = ({own[0]: 1.0}, sum(c * math.log(p[own[0]][g]) for g, c in counts.items())) if k == 1 else fit(own, {n: share[n] / sum(share[m] for m in own) for n in own}, langid.ROUNDS // 2)
        like -= langid.PENALTY * k * max(1.0, math.log(total) / 4)
        if best is None or like > best[0]:
            best = like, part
        elif k > 2:
            break
    top = max(best[1], key=lambda n: best[1][n])
    return top, best[1][top]


def test_mixture_by_definition():
    texts = {"de": GERMAN, "en": ENGLISH, "es": SPANISH}
    model = langid.Mixture(sorted(texts), np.array([langid.grams(texts[n] * 3) for n in sorted(texts)]))
    trained = {n: plain_grams(t * 3) for n, t in texts.items()}
    for text in (ENGLISH, GERMAN[:40], ENGLISH * 2 + SPANISH, "fox hund", GERMAN * 3 + ENGLISH * 2 + SPANISH, "Straße x", "ÜBER den Hund"):
        assert langid.grams(text).sum() == sum(plain_grams(text).values())
        want, got = plain_mixture(trained, text), model.predict(text)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-9)


def test_languages_of_any_size_are_drawn(spark):
    """The share of a language that is drawn has no least step."""
    rows = [(i, ENGLISH, "en") for i in range(400)] + [(1000 + i, GERMAN, "de") for i in range(30)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20)
    assert model.names == ["de", "en"] and model.predict(ENGLISH)[0] == "en"


def test_attention_by_definition():
    rng = np.random.default_rng(4)
    w = {"mean": rng.normal(size=quality.WIDTH), "scale": rng.random(quality.WIDTH) + 0.5, "e": rng.normal(size=3), "b": rng.normal(size=1), "E": rng.normal(size=(quality.WIDTH, 3)), "V": rng.normal(size=(3, 2)), "U": rng.normal(size=(3, 2)), "a": rng.normal(size=2), "c": rng.normal(size=3)}
    x, owner = rng.normal(size=(7, quality.WIDTH)), np.array([0, 0, 0, 1, 2, 2, 2])
    got = quality.Attention(w).forward(x, owner, 3)[0]
    for k in range(3):
        h = [[math.tanh(sum((row[i] - w["mean"][i]) / w["scale"][i] * w["E"][i][j] for i in range(quality.WIDTH)) + w["e"][j]) for j in range(3)] for row in x[owner == k]]
        gate = []
        for u in h:
            t = [math.tanh(sum(u[j] * w["V"][j][m] for j in range(3))) for m in range(2)]
            s = [1 / (1 + math.exp(-sum(u[j] * w["U"][j][m] for j in range(3)))) for m in range(2)]
            gate.append(math.exp(sum(t[m] * s[m] * w["a"][m] for m in range(2))))
        z = [sum(g / sum(gate) * u[j] for g, u in zip(gate, h, strict=True)) for j in range(3)]
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(sum(z[j] * w["c"][j] for j in range(3)) + w["b"][0]))))


def test_passages_by_definition():
    text = " ".join(["Ab", "cd!", "12", "cd!", "ÄÖ", "x,"] * 20)
    buf = np.frombuffer(text.encode(), np.uint8)
    x, owner = quality.encode(buf, np.array([0, len(buf)]))
    words = text.split(" ")
    assert len(x) == -(-len(words) // quality.PASSAGE) and not owner.any()
    for k in range(len(x)):
        own = words[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]
        assert x[k, 9] == pytest.approx(len(set(own)) / len(own)) and x[k, 10] == pytest.approx(sum(len(v.encode()) for v in own) / len(own) / 10)
        assert x[k, 11] == pytest.approx(sum(v[0].isascii() and v[0].isupper() for v in own) / len(own)) and x[k, 15] == pytest.approx(len(own) / quality.PASSAGE)
        raw = (" ".join(own) + (" " if k + 1 < len(x) else "")).encode()
        assert x[k, 3] == pytest.approx(sum(48 <= b < 58 for b in raw) / len(raw)) and x[k, 7] == pytest.approx(sum(b >= 128 for b in raw) / len(raw))


def test_training_is_bounded_by_passages(spark):
    rows = [(i, (ENGLISH if i % 2 else "x9$ !! %% 7 ") * (400 if i < 4 else 5)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert min(got[i] for i in range(1, 40, 2)) > max(got[i] for i in range(0, 40, 2))


def test_texts_of_megabytes(spark):
    """Whole texts of some megabytes, a single word of one, and short ones between them."""
    rng = np.random.default_rng(1)
    long = " ".join(f"w{k}" for k in rng.integers(0, 5000, 500_000))
    rows = [(1, long), (2, "short text of five words"), (3, "y" * 3_000_000), (4, long.replace("w7 ", "w8 ")), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    assert got[4].component_id == got[1].component_id == 1 and got[3].n_shingles == got[2].n_shingles == 1 and got[5].n_shingles == 0
    from pyspark.sql import functions as F

    scored = {r.doc_id: r for r in lm.score_texts(docs, F.col("doc_id") != 4).collect()}
    assert scored[1].n_tokens == 500_001 and scored[3].n_tokens == 2 and scored[4].score > scored[4].base_score
    page = "<main>" + "".join(f"<p>Paragraph {i}, of a very long page, with words.</p>" for i in range(60_000)) + "</main>"
    assert htmltext.main_text(page).count("\n\n") == 59_999
    words = extracted(docs.select("text").toArrow().column(0), lambda b, o: [textkernel.word_hashes(b, o)])[0][0]
    assert len(words) == 1_000_006
