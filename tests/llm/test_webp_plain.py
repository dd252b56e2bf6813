"""Written files, read by a second decoder that takes one bit after the other; and long texts in bounded memory."""

import random
import tracemalloc

import numpy as np
import pytest

from tamis.llm import media, webp


def plain_images(data):
    """Green samples of each image of a file with palette transforms, back-references and prefix codes, from the public format."""
    assert data[:4] == b"RIFF" and data[8:12] == b"WEBP" and int.from_bytes(data[4:8], "little") == len(data) - 8

    def walk(at, end):
        while at < end:
            name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name == b"VP8L":
                yield plain_image(data[at + 8 : at + 8 + n])
            elif name == b"ANMF":
                yield from walk(at + 24, at + 8 + n)
            at += 8 + n + n % 2

    return list(walk(12, len(data)))


def plain_image(stream):
    at = 0

    def bits(n):
        nonlocal at
        v = 0
        for k in range(n):
            v |= (stream[at // 8] >> at % 8 & 1) << k
            at += 1
        return v

    def code(lengths):
        table, value, last = {}, 0, 0
        for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
            value <<= n - last
            last = n
            table[f"{value:0{n}b}"] = s
            value += 1
        return table

    def symbol(table):
        if len(table) == 1:
            return next(iter(table.values()))
        word = ""
        while word not in table:
            word += str(bits(1))
        return table[word]

    def read_code(size):
        lengths = [0] * size
        if bits(1):
            two = bits(1)
            lengths[bits(8 if bits(1) else 1)] = 1
            if two:
                lengths[bits(8)] = 1
            return code(lengths)
        own = [0] * 19
        for s in [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15][: 4 + bits(4)]:
            own[s] = bits(3)
        own, i, before = code(own), 0, 8
        assert not bits(1)
        while i < size:
            s = symbol(own)
            if s < 16:
                lengths[i] = s
                i, before = i + 1, s or before
            else:
                for _ in range(3 + bits(2) if s == 16 else 3 + bits(3) if s == 17 else 11 + bits(7)):
                    lengths[i] = before if s == 16 else 0
                    i += 1
        return code(lengths)

    def amount(s):
        return s + 1 if s < 4 else ((2 + s % 2) << (s - 2) // 2) + bits((s - 2) // 2) + 1

    def image(width, height, main):
        assert not bits(1) and not (main and bits(1))
        green, red, blue, alpha, far = (read_code(n) for n in (280, 256, 256, 256, 40))
        out = []
        while len(out) < width * height:
            s = symbol(green)
            if s < 256:
                out.append((symbol(alpha), symbol(red), s, symbol(blue))[::1])
                continue
            n, d = amount(s - 256), amount(symbol(far))
            assert d > 120
            for _ in range(n):
                out.append(out[-(d - 120)])
        return out

    assert bits(8) == 0x2F
    width, height = bits(14) + 1, bits(14) + 1
    bits(1)
    assert not bits(3)
    if not bits(1):
        return [p[2] for p in image(width, height, True)]
    assert bits(2) == 3
    n = bits(8) + 1
    table = [p[2] for p in image(n, 1, False)]
    table = [sum(table[: k + 1]) % 256 for k in range(n)]
    assert not bits(1)
    per = 8 if n <= 2 else 4 if n <= 4 else 2
    wide = -(-width // per)
    packed, out = [p[2] for p in image(wide, height, True)], []
    for y in range(height):
        for x in range(width):
            out.append(table[packed[y * wide + x // per] >> x % per * (8 // per) & (1 << 8 // per) - 1])
    return out


def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghiäß漢") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    line = prose(30)
    yield from ("", "a", "ab" * 300, prose(40), prose(900), "\n".join([line, prose(20), line, line, prose(5), line]), "x" * 5000, "".join(map(chr, range(1, 256))) * 3, "aaaaaaaaab" * 200 + prose(20))


@pytest.mark.parametrize("text", list(texts()))
def test_second_decoder_agrees(text):
    _, payload = media.payload_of(text)
    stored = media.store(payload)
    (samples,) = plain_images(stored)
    assert bytes(samples) == payload == media.read_back(stored).tobytes()


def test_skewed_counts_keep_codes_short():
    counts = np.array([1 << k for k in range(30)] + [0])
    sizes = webp.code_lengths(counts, 12)
    assert sizes.max() <= 12 and sizes[-1] == 0 and sum(2.0 ** -float(n) for n in sizes if n) == 1
    plain = webp.code_lengths(np.array([5, 9, 12, 13, 16, 45]), 15)
    assert sorted(plain.tolist()) == [1, 3, 3, 3, 4, 4]


def test_frames_of_long_texts():
    rng = random.Random(8)
    text = " ".join(rng.choice(["some", "long", "text", "of", "many", "frames", str(rng.random())]) for _ in range(400_000))
    _, payload = media.payload_of(text)
    assert len(payload) > 4 * media.UNIT * media.ROWS
    tracemalloc.start()
    stored = media.store(payload)
    back = media.read_back(stored)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert back.tobytes() == payload and sum(1 for _ in webp.frames(stored)) == -(-len(payload) // (media.UNIT * media.ROWS))
    assert peak < 15 * len(payload) + 60_000_000  # a few times the payload, and a frame's working space
    assert bytes(sum(plain_images(media.store(payload[: 192 * 2050])), [])) == payload[: 192 * 2050]
