"""Byte-level BPE, media columns, language and quality: against libraries, round trips and held-out accuracy."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from odd import SCHEMA, documents

from tamis.llm import bpe, langid, media, quality, textkernel, webp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


def test_bpe_equals_tiktoken(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    real = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(bpe.encode(docs).collect(), key=str)
    want = []
    for r in documents():
        ids, raw = real.encode_ordinary(r[1] or ""), (r[1] or "").encode()
        assert real.decode_bytes(ids) == raw
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), ids))
    assert [tuple(r) for r in got] == [(*w[:4], w[4]) for w in sorted(want, key=lambda w: str(spark_row(w)))]


def spark_row(w):
    from pyspark.sql import Row

    return Row(doc_id=w[0], n_tokens=w[1], ids_sha256=w[2], decoded_sha256=w[3], ids=w[4])


def test_bpe_pieces_of_long_texts(monkeypatch):
    b = bpe.ByteBpe.load(public_tokenizers.path(bpe.VOCABULARY))
    text = documents()[-3][1]
    whole = b.digest(text)
    monkeypatch.setattr(bpe, "PIECE", 100)
    kept = []
    assert b.digest(text, kept) == whole
    assert b.decode(np.concatenate(kept).tolist()) == text.encode()


def test_perfect_hash_has_no_holes():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slots.tolist()) == list(range(5000)) and all(h.find(k) == i for i, k in enumerate(keys))
    assert h.find(b"absent") == -1 and bpe.PerfectHash([]).find(b"x") == -1


def test_media_round_trip(docs):
    rows = media.describe(docs).collect()
    assert len(rows) == len(documents())
    by_text = {}
    for r, d in zip(sorted(rows, key=lambda r: (str(r.doc_id), r.payload_sha256)), sorted(documents(), key=lambda d: (str(d[0]), hashlib.sha256(media.payload_of(d[1])[1]).hexdigest())), strict=True):
        n, payload = media.payload_of(d[1])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.payload_bytes % 192 == 0 < r.payload_bytes
        assert media.read_back(bytes(r.media)).tobytes() == payload and r.media_bytes == len(r.media)
        assert by_text.setdefault(d[1] or "", (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_webp_wide_images_and_repeats():
    for payload in (b"ab" * 192, b"line one is here, and it is rather long for a line of text\n" * 5000, bytes(range(256)) * 3, bytes(192 * 20_000)):
        payload = payload.ljust(-(-len(payload) // 192) * 192, b" ")
        stored = media.store(payload)
        assert media.read_back(stored).tobytes() == payload
    assert len(media.store(b"x" * 96 + b"yz" * 48)) < 120


def put_even(w, values, size=256):
    """A code of 8-bit literals, all of one length."""
    w.put(*webp.normal_code(even(np.arange(256), 8, size)))


def even(symbols, n, size):
    out = np.zeros(size, np.uint8)
    out[symbols] = n
    return out.tobytes()


def stream(pixels, transforms=(), cache=0, meta=False):
    """A lossless WebP of ARGB pixels with literals (and cache hits) only, and the transforms given, for the decoder's tests."""
    height, width = pixels.shape
    w = webp.Writer()
    for value, n in ((webp.SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    turned = lambda v, n: int(format(v, f"0{n}b")[::-1], 2)

    def image(p, main):
        w.put(1, 1) if cache and main else w.put(0, 1)
        if cache and main:
            w.put(cache, 4)
        if main:
            w.put(1 if meta else 0, 1)
            if meta:
                w.put(0, 3)  # blocks of 4
                blocks = np.zeros((-(-height // 4), -(-width // 4)), np.uint32)
                blocks[:, 1::2] = 1 << 8
                image(blocks, False)
        for _ in range(2 if meta and main else 1):
            hit = cache and main
            n = 9 if hit else 8
            symbols = np.arange(256) if not hit else np.concatenate([np.arange(256), 256 + np.arange(24), 280 + np.arange(1 << cache)])
            symbols = symbols[: 1 << n] if len(symbols) >= 1 << n else np.arange(256)
            n = len(symbols).bit_length() - 1
            w.put(*webp.normal_code(even(symbols, n, 280 + ((1 << cache) if hit else 0))))
            for _ in range(3):
                put_even(w, None)
            webp.put_simple(w, 0)
        seen = {}
        for v in p.ravel().tolist():
            slot = (v * webp.CACHE_FACTOR & 0xFFFFFFFF) >> 32 - cache if cache else 0
            if cache and main and seen.get(slot) == v and 280 + slot < 1 << n:
                w.put(turned(280 + slot, n), n)
            else:
                w.put(turned(v >> 8 & 255, n), n)
                for s in (16, 0, 24):
                    w.put(turned(v >> s & 255, 8), 8)
            seen[slot] = v

    for kind, extra in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind == webp.PALETTE:
            w.put(len(extra) - 1, 8)
            c = webp.channels(extra).astype(np.int64)
            image(webp.packed(np.diff(c, axis=0, prepend=0) & 255), False)
        elif kind in (webp.PREDICTOR, webp.CROSS_COLOUR):
            w.put(0, 3)
            image(extra, False)
    w.put(0, 1)
    image(pixels, True)
    return webp.riff(webp.chunk(b"VP8L", w.bytes()))


def residual(pixels, modes):
    c = webp.channels(pixels)
    out = np.zeros_like(c)
    for y in range(c.shape[0]):
        for x in range(c.shape[1]):
            out[y, x] = (c[y, x].astype(int) - webp.predicted(c, y, x, modes, 2)) & 255
    return webp.packed(out)


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(mode):
    rng = np.random.default_rng(mode)
    pixels = rng.integers(0, 2**32, (7, 9), dtype=np.uint32)
    modes = np.full((2, 3), mode, np.uint32)
    data = stream(residual(pixels, modes), [(webp.PREDICTOR, modes << np.uint32(8))])
    assert (webp.decode(data) == pixels).all()


def test_webp_colour_transforms_cache_and_groups():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 2**32, (9, 10), dtype=np.uint32)
    pixels[3:6] = pixels[0]
    factors = rng.integers(0, 2**24, (3, 3), dtype=np.uint32)
    assert (webp.decode(stream(webp.cross_colour(pixels, factors, 2, -1), [(webp.CROSS_COLOUR, factors)])) == pixels).all()
    assert (webp.decode(stream(webp.add_green(pixels, -1), [(webp.SUBTRACT_GREEN, None)])) == pixels).all()
    both = webp.add_green(webp.cross_colour(pixels, factors, 2, -1), -1)
    assert (webp.decode(stream(both, [(webp.CROSS_COLOUR, factors), (webp.SUBTRACT_GREEN, None)])) == pixels).all()
    assert (webp.decode(stream(pixels, cache=8)) == pixels).all()
    assert (webp.decode(stream(pixels, meta=True)) == pixels).all()


def test_webp_palette_with_bundles():
    rng = np.random.default_rng(2)
    for n in (2, 3, 4, 9, 16, 40):
        table = rng.integers(0, 2**32, n, dtype=np.uint32)
        index = rng.integers(0, n, (5, 11))
        shift = webp.bundling(n)
        per, each = 1 << shift, 8 >> shift
        padded = np.pad(index, ((0, 0), (0, -11 % per))).reshape(5, -1, per)
        packed = ((padded << np.arange(per) * each).sum(-1) << 8).astype(np.uint32)
        w = stream_of_width(packed, table, 11)
        assert (webp.decode(w) == table[index]).all()


def stream_of_width(packed, table, width):
    data = bytearray(stream(packed, [(webp.PALETTE, table)]))
    bits = int.from_bytes(data[21:25], "little")
    data[21:25] = (bits & ~0x3FFF | width - 1).to_bytes(4, "little")
    return bytes(data)


def test_webp_refuses_damage():
    good = media.store(b"some text ".ljust(192))
    for bad in (b"", good[:20], b"RIFX" + good[4:], good[:21] + b"\xff" * 6):
        with pytest.raises((ValueError, IndexError, KeyError, Exception)):
            webp.decode(bad)


def test_distance_map():
    assert webp.distance_map()[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)]
    assert webp.distance_map()[-3:] == [(-7, 7), (8, 6), (8, 7)] and len(set(webp.distance_map())) == 120


def test_language_accuracy_and_odd_texts(spark, docs):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in langid.op5_language_id(spark, SF).collect()}
    rows = real.collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(out[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held) > 0
    got = langid.identify(docs, langid.train(docs), keep=("doc_id", "text")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    none = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), none).count() == 0


def test_mixture_finds_both_languages(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").where("lang in ('en', 'de')").collect()
    counts = {k: sum(langid.grams(r.text) for r in real if r.lang == k) for k in ("de", "en")}
    m = langid.Mixture(["de", "en"], np.array([counts["de"], counts["en"]]))
    de, en = (next(r.text for r in real if r.lang == k and len(r.text) > 800)[:700] for k in ("de", "en"))
    name, share = m.predict(de + " " + en + " " + en)
    assert name == "en" and 0.4 < share < 0.9
    assert m.predict(de)[1] > 0.9


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = [r for r in quality.op4_quality_classifier(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in out if labels[r.doc_id] == k] for k in (1, 0))
    assert good and bad and np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in out)


def test_quality_odd_texts(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None), (3, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.train(docs, labels.where("quality = 1")) == 1.0 and quality.train(docs, labels.limit(0)) == 0.5
    assert quality.score(docs.limit(0), model).count() == 0 and {r.score for r in quality.score(docs, 0.5).collect()} == {0.5}


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x, owner, y = rng.normal(size=(6, quality.WIDTH)), np.array([0, 0, 1, 1, 1, 2]), np.array([1.0, 0, 1])
    w = {k: rng.normal(0, 0.2, s) for k, s in {"E": (quality.WIDTH, quality.HIDDEN), "e": quality.HIDDEN, "V": (quality.HIDDEN, quality.GATE), "U": (quality.HIDDEN, quality.GATE), "a": quality.GATE, "c": quality.HIDDEN, "b": 1}.items()}
    w |= {"mean": np.zeros(quality.WIDTH), "scale": np.ones(quality.WIDTH)}
    model = quality.Attention(w)
    loss = lambda: -np.mean(y * np.log(s := model.forward(x, owner, 3)[0]) + (1 - y) * np.log(1 - s))
    for k, g in model.step(x, owner, y).items():
        at = tuple(0 for _ in w[k].shape)
        before, eps = loss(), 1e-6
        w[k][at] += eps
        assert abs((loss() - before) / eps - g[at]) < 1e-4


def test_word_hashes_follow_texts():
    texts = ["Ab cd", None, "", "cd  ab\n", "x" * 600 + " AB", "ab"]
    seen = {}
    for _, buf, offsets in textkernel.slabs(pa.array(texts), 4):
        h, doc = textkernel.word_hashes(buf, offsets)
        n = len(offsets) - 1
        for i in range(n):
            word = bytes(textkernel.LOWER[buf[offsets[i] : offsets[i + 1]]]).split()
            for a, b in zip(word, h[doc == i].tolist(), strict=True):
                assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen) == 3
