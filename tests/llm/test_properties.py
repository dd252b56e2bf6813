"""Properties over arbitrary inputs."""

import base64
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tamis.llm import bpe, htmltext, jaccard, langid, media, quality, textkernel

TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=120)
_BPE = bpe.ByteBpe.load(public_tokenizers.path(bpe.VOCABULARY))
_REAL = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_bpe(text):
    ids = _BPE.encode(text)
    assert ids == _REAL.encode_ordinary(text) and _BPE.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.one_of(TEXT, st.lists(TEXT, max_size=6).map(lambda xs: "\n".join(xs * 9))))
def test_media(text):
    _, payload = media.payload_of(text)
    assert media.read_back(media.store(payload)).tobytes() == payload


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=900))
def test_media_of_any_bytes(data):
    payload = data.ljust(-(-len(data) // 192) * 192, b" ")
    assert media.read_back(media.store(payload)).tobytes() == payload


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 300))
def test_words_and_shingles(texts, size):
    seen_words, seen_sets = {}, {}
    for i, buf, offsets in textkernel.slabs(pa.array(texts, pa.string()), size):
        h, doc = textkernel.word_hashes(buf, offsets)
        s, owner = jaccard.shingles(buf, offsets)
        for k in range(len(offsets) - 1):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[i + k] or "")
            words = re.findall(r"[^\x20\x09-\x0D]+", low)
            assert len(words) == (doc == k).sum()
            for w, x in zip(words, h[doc == k].tolist(), strict=True):
                assert seen_words.setdefault(w, x) == x
            want = {tuple(words[j : j + 5]) for j in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
            got = frozenset(s[owner == k].tolist())
            assert len(got) == len(want) == (owner == k).sum()
            assert seen_sets.setdefault(frozenset(want), got) == got
    assert len(set(seen_words.values())) == len(seen_words)


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_passages(texts):
    """A text's features don't depend on what else is in the batch."""
    together: dict[int, np.ndarray] = {}
    for i, buf, offsets in textkernel.slabs(pa.array(texts)):
        x, owner = quality.encode(buf, offsets)
        together |= {i + k: x[owner == k] for k in range(len(offsets) - 1)}
    for k, t in enumerate(texts):
        _, buf, offsets = next(textkernel.slabs(pa.array([t])))
        x, _ = quality.encode(buf, offsets)
        assert x.shape == together[k].shape and np.allclose(x[:, 8:16], together[k][:, 8:16], atol=1e-5) and np.isfinite(x).all()


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_html_of_any_text(text):
    out = htmltext.main_text(f"<article><p>{text}</p></article>")
    assert "\n\n\n" not in out and out == out.strip()
    htmltext.main_text(text)


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_grams(text):
    assert langid.grams(text).sum() <= len((" " + text.lower() + " ").encode())
