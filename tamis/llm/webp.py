"""Lossless WebP in numpy: a decoder of the whole format, and an encoder for 8-bit samples.

The decoder reads prefix codes (simple and normal, single or grouped by an entropy image), literals,
back-references with the distance map, the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms (the last with pixel bundling). Its result is an array of ARGB pixels for
each frame.

Where an image has one group of codes, no cache, and constant red, blue and alpha, symbols are looked up at all
bit positions at once, and one pass over them finds those that are read; other images go pixel by pixel. Both
give the same pixels. The encoder writes such images: variable-length prefix codes of the samples and of
back-references to earlier words and lines, and palettes where there are few different samples.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np

# Fixed values of the format, from its public specification.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


@functools.cache
def distance_map() -> list[tuple[int, int]]:
    """The 120 nearby offsets (dx, dy), by squared distance, then by the size of dx, positive first."""
    near = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0]
    near.sort(key=lambda o: (o[0] ** 2 + o[1] ** 2, abs(o[0]), -o[0]))
    return near[:120]


class Bits:
    """Reader of a little-endian bit stream."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        a = self.at
        return int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        got = self.peek(n) if n else 0
        self.at += n
        return got


@functools.cache
def turned() -> np.ndarray:
    """The numbers of 15 bits with their bits in reverse."""
    n, out = np.arange(1 << 15), np.zeros(1 << 15, np.int64)
    for k in range(15):
        out |= (n >> k & 1) << (14 - k)
    return out


def reversed_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols that have a code, their canonical codes with the first bit lowest)."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[used].astype(np.int64)
    top = int(size[-1]) if len(size) else 0
    weight = 1 << (top - size)
    code = (np.cumsum(weight) - weight) >> (top - size)
    return used, turned()[code] >> (15 - size)


class Prefix:
    """One prefix code: symbols and sizes by the next `top` bits."""

    def __init__(self, lengths: np.ndarray | None, one: int | None = None):
        if lengths is not None and np.count_nonzero(lengths) == 1:
            one = int(np.argmax(lengths))
        self.one, self.top = one, int(lengths.max()) if one is None else 0
        self.symbols = np.full(1 << self.top, one or 0, np.uint16)
        self.sizes = np.zeros(1 << self.top, np.uint8)
        if self.top:
            used, codes = reversed_codes(lengths)
            size = lengths[used].astype(np.int64)
            if int((1 << (self.top - size)).sum()) != 1 << self.top:
                raise ValueError("incomplete prefix code")
            for symbol, code, n in zip(used.tolist(), codes.tolist(), size.tolist(), strict=True):
                self.symbols[code :: 1 << n] = symbol
                self.sizes[code :: 1 << n] = n

    @classmethod
    def read(cls, bits: Bits, size: int) -> Prefix:
        lengths = np.zeros(size, np.int64)
        if bits.read(1):
            two = bits.read(1)
            first = bits.read(8 if bits.read(1) else 1)
            if not two:
                return single(first)
            lengths[[first, bits.read(8)]] = 1
            return cls(lengths)
        own = np.zeros(19, np.int64)
        for k in range(4 + bits.read(4)):
            own[CODE_LENGTH_ORDER[k]] = bits.read(3)
        code, left = cls(own), size
        if bits.read(1):
            left = 2 + bits.read(2 + 2 * bits.read(3))
        i, before = 0, 8
        while i < size and left:
            left -= 1
            s = code.next(bits)
            if s < 16:
                lengths[i], i = s, i + 1
                before = s or before
            else:
                n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
                lengths[i : i + n], i = before if s == 16 else 0, i + n
        return cls(lengths)

    def next(self, bits: Bits) -> int:
        if self.one is not None:
            return self.one
        at = bits.peek(self.top)
        bits.at += int(self.sizes[at])
        return int(self.symbols[at])


@functools.cache
def single(symbol: int) -> Prefix:
    return Prefix(None, symbol)


def extended(bits: Bits, symbol: int) -> int:
    """Length or distance of a prefix symbol."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def backward(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = distance_map()[code - 1]
    return max(1, dx + dy * width)


def entropy_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """Pixels (ARGB as uint32) of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, of, block = 1, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        meta = entropy_image(bits, -(-width >> block), -(-height >> block))
        of = (meta >> 8 & 0xFFFF).reshape(-(-height >> block), -1)
        groups = int(of.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[Prefix.read(bits, n) for n in sizes] for _ in range(groups)]
    if groups == 1 and not cache_bits and all(c.one is not None for c in codes[0][1:4]):
        return at_once(bits, codes[0], width, height)
    total, i, pixels = width * height, 0, [0] * (width * height)
    cache, mask = [0] * (1 << cache_bits), (1 << cache_bits) - 1 if cache_bits else 0
    while i < total:
        green, red, blue, alpha, far = codes[int(of[i // width >> block, i % width >> block]) if of is not None else 0]
        s = green.next(bits)
        if s < 256:
            new = [red.next(bits) << 16 | s << 8 | blue.next(bits)]
            new[0] |= alpha.next(bits) << 24
        elif s < 280:
            n = extended(bits, s - 256)
            d = backward(extended(bits, far.next(bits)), width)
            if d > i or i + n > total:
                raise ValueError("back-reference out of the image")
            new = []
            for k in range(n):
                new.append(pixels[i + k - d] if k < d else new[k - d])
        else:
            if s - 280 > mask:
                raise ValueError("no such cache entry")
            new = [cache[s - 280]]
        for p in new:
            pixels[i] = p
            i += 1
            if cache_bits:
                cache[(p * CACHE_FACTOR & 0xFFFFFFFF) >> 32 - cache_bits] = p
    return np.array(pixels, np.uint32)


def amounts(symbol: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Lengths or distances of prefix symbols and their extra bits."""
    n = np.maximum(symbol - 2, 0) >> 1
    return np.where(symbol < 4, symbol, (2 + (symbol & 1)) << n) + np.where(symbol < 4, 0, extra) + 1


def references(words: np.ndarray, at: np.ndarray, symbol: np.ndarray, far: Prefix, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, distance, bits) of the back-references whose extra bits begin at bit positions `at`; words: 8 bytes from each byte on."""
    low = lambda x, n: x & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))
    more = lambda s: np.maximum(s - 2, 0) >> 1
    x = words[at >> 3] >> (at & 7).astype(np.uint64)
    n = more(symbol)
    size = amounts(symbol, low(x, n).astype(np.int64))
    x = x >> n.astype(np.uint64)
    window = (x & np.uint64((1 << far.top) - 1)).astype(np.int64)
    s, taken = far.symbols[window].astype(np.int64), far.sizes[window].astype(np.int64)
    m = more(s)
    code = amounts(s, low(x >> taken.astype(np.uint64), m).astype(np.int64))
    near = np.array([max(1, dx + dy * width) for dx, dy in distance_map()])
    return size, np.where(code > 120, code - 120, near[np.minimum(code, 120) - 1]), n + taken + m


def at_once(bits: Bits, codes: list[Prefix], width: int, height: int, block: int = 1 << 15) -> np.ndarray:
    """Images whose other channels are constant: all symbols of a block of the stream are looked up together."""
    green, red, blue, alpha, far = codes
    total, i = width * height, 0
    out = np.empty(total, np.uint8)
    if green.one is not None:
        out[:], i = green.one, total
    while i < total:
        base, p = bits.at >> 3, bits.at & 7
        n = min(block, len(bits.data) - base)
        if n <= 0:
            raise ValueError("the image ends early")
        part = np.frombuffer(bits.data[base : base + n + 48].ljust(n + 48, b"\0"), np.uint8)
        words = np.ndarray((n + 40,), "<u8", part, strides=(1,))
        window = (words.astype(np.uint32)[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32((1 << green.top) - 1)).ravel()
        symbol, size = green.symbols[window], green.sizes[window]
        marks = np.flatnonzero(symbol[: 8 * n + 240] >= 256)
        if len(marks):
            of = np.full(len(symbol), -1, np.int32)
            of[marks] = np.arange(len(marks))
            length, distance, taken = references(words, marks + size[marks], symbol[marks].astype(np.int64) - 256, far, width)
            size[marks] += taken.astype(np.uint8)
        place, last = np.arange(len(size)), len(size) - 1
        two = size + size[np.minimum(place + size, last)]
        steps, read = (two + two[np.minimum(place + two, last)]).tobytes(), []  # four symbols have 232 bits at most
        add, end = read.append, 8 * n
        while p < end:
            add(p)
            p += steps[p]
        at = np.empty((len(read), 4), np.int64)
        at[:, 0] = read
        at[:, 2] = at[:, 0] + two[at[:, 0]]
        at[:, 1], at[:, 3] = at[:, 0] + size[at[:, 0]], at[:, 2] + size[at[:, 2]]
        at = at.ravel()
        if (after := at[at >= end]).size:
            at, p = at[at < end], int(after[0])
        got = symbol[at]
        if len(marks) and (refs := np.flatnonzero(got >= 256)).size:
            k = 0
            for r, m in zip(refs.tolist(), of[at[refs]].tolist(), strict=True):
                free = min(r - k, total - i)
                out[i : i + free] = got[k : k + free]
                i, k = i + free, r
                if i == total:
                    break
                many, d = int(length[m]), int(distance[m])
                if d > i or i + many > total:
                    raise ValueError("back-reference out of the image")
                while many:  # what overlaps doubles each round
                    c = min(many, d)
                    out[i : i + c] = out[i - d : i - d + c]
                    i, many, d = i + c, many - c, d + c if c == d else d
                k = r + 1
                if i == total:
                    break
        else:
            k = 0
        free = min(len(got) - k, total - i)
        if free and i < total:
            if (got[k : k + free] >= 256).any():
                raise ValueError("back-reference out of the image")
            out[i : i + free] = got[k : k + free]
            i, k = i + free, k + free
        bits.at = 8 * base + (int(at[k]) if k < len(at) else p)
    if bits.at > 8 * len(bits.data):
        raise ValueError("the image ends early")
    fixed = np.uint32(alpha.one << 24 | red.one << 16 | blue.one)
    return fixed | out.astype(np.uint32) << np.uint32(8)


def channels(pixels: np.ndarray) -> np.ndarray:
    """uint8 [..., (A, R, G, B)] of ARGB."""
    return np.stack([(pixels >> np.uint32(s) & np.uint32(255)).astype(np.uint8) for s in (24, 16, 8, 0)], -1)


def packed(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _predict(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Prediction from the pixel's left, top, top-left and top-right neighbours, each int (A, R, G, B)."""
    mean = lambda a, b: (a + b) >> 1
    clamp = lambda a: np.clip(a, 0, 255)
    if mode in (0, 14, 15):
        return np.array([255, 0, 0, 0])
    if mode == 11:
        p = left + top - corner
        return left if np.abs(p - left).sum() < np.abs(p - top).sum() else top
    if mode == 13:
        m = mean(left, top)
        return clamp(m + np.trunc((m - corner) / 2).astype(int))
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: mean(mean(left, right), top), 6: lambda: mean(left, corner), 7: lambda: mean(left, top),
        8: lambda: mean(corner, top), 9: lambda: mean(top, right), 10: lambda: mean(mean(left, corner), mean(top, right)), 12: lambda: clamp(left + top - corner),
    }[mode]()


def predicted(c: np.ndarray, y: int, x: int, modes: np.ndarray, block: int) -> np.ndarray:
    """What is predicted for a pixel from those before it; c: channels [height, width, 4], done up to here."""
    if not y and not x:
        return np.array([255, 0, 0, 0])
    if not y:
        return c[0, x - 1].astype(int)
    top = c[y - 1, x].astype(int)
    if not x:
        return top
    right = c[y - 1, x + 1] if x + 1 < c.shape[1] else c[y, 0]
    return _predict(int(modes[y >> block, x >> block]), c[y, x - 1].astype(int), top, c[y - 1, x - 1].astype(int), right.astype(int))


def invert_predictor(pixels: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    rest = channels(pixels)
    height, width = pixels.shape
    if (modes == 2).all():  # all from the pixel above: sums down the columns
        first = rest[0].astype(np.int64)
        first[0] += (255, 0, 0, 0)
        whole = np.concatenate([np.cumsum(first, 0)[None], rest[1:].astype(np.int64)])
        return packed((np.cumsum(whole, 0) & 255).astype(np.uint8))
    out = np.zeros_like(rest)
    for y in range(height):
        for x in range(width):
            out[y, x] = (rest[y, x] + predicted(out, y, x, modes, block)) & 255
    return packed(out)


def cross_colour(pixels: np.ndarray, factors: np.ndarray, block: int, sign: int) -> np.ndarray:
    """Add (sign 1, decoding) or take away (-1) the shares of green and red; factors: the transform's image."""
    height, width = pixels.shape
    f = channels(factors.repeat(1 << block, 0).repeat(1 << block, 1)[:height, :width]).astype(np.int8).astype(np.int64)
    c = channels(pixels).astype(np.int64)
    signed = lambda x: ((x & 255) ^ 128) - 128
    red_blue, green_blue, green_red = f[..., 1], f[..., 2], f[..., 3]
    old = c[..., 1].copy()
    c[..., 1] += sign * (green_red * signed(c[..., 2]) >> 5)
    c[..., 3] += sign * (green_blue * signed(c[..., 2]) >> 5)
    c[..., 3] += sign * (red_blue * signed(c[..., 1] if sign > 0 else old) >> 5)
    return packed((c & 255).astype(np.uint8))


def add_green(pixels: np.ndarray, sign: int = 1) -> np.ndarray:
    c = channels(pixels)
    for k in (1, 3):
        c[..., k] = (c[..., k].astype(np.int64) + sign * c[..., 2].astype(np.int64)) & 255
    return packed(c)


def unbundle(pixels: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Colours of a palette image; small palettes have 2, 4 or 8 indices in a pixel's green."""
    shift = bundling(len(table))
    index = (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    if shift:
        each = 8 >> shift
        index = (index[..., None] >> (np.arange(1 << shift) * each) & (1 << each) - 1).reshape(len(pixels), -1)[:, :width]
    whole = np.zeros(256, np.uint32)
    whole[: len(table)] = table
    return whole[index]


def bundling(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def chunks(data: bytes, at: int = 12) -> Iterator[tuple[bytes, bytes]]:
    while at + 8 <= len(data):
        n = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)


def frames(data: bytes) -> Iterator[np.ndarray]:
    """ARGB pixels [height, width] of the image of a lossless WebP file, or of each frame where there are several."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    for name, body in chunks(data):
        if name == b"VP8L":
            yield pixels_of(body)
        elif name == b"ANMF":
            yield from (pixels_of(inner) for kind, inner in chunks(body, 16) if kind == b"VP8L")


def decode(data: bytes) -> np.ndarray:
    """Pixels of the first image."""
    for image in frames(data):
        return image
    raise ValueError("no lossless image")


def pixels_of(stream: bytes) -> np.ndarray:
    """Pixels of one lossless bit stream."""
    bits = Bits(stream)
    if bits.read(8) != SIGNATURE:
        raise ValueError("bad signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            w, h = -(-wide >> block), -(-height >> block)
            image = entropy_image(bits, w, h).reshape(h, w)
            if kind == PREDICTOR:
                undo.append(lambda p, m=image >> np.uint32(8) & np.uint32(15), b=block: invert_predictor(p, m, b))
            else:
                undo.append(lambda p, f=image, b=block: cross_colour(p, f, b, 1))
        elif kind == SUBTRACT_GREEN:
            undo.append(add_green)
        else:
            n = bits.read(8) + 1
            table = packed((np.cumsum(channels(entropy_image(bits, n, 1)).astype(np.int64), 0) & 255).astype(np.uint8))
            undo.append(lambda p, t=table, w=wide: unbundle(p, t, w))
            wide = -(-wide >> bundling(n))
    pixels = entropy_image(bits, wide, height, main=True).reshape(height, wide)
    for f in reversed(undo):
        pixels = f(pixels)
    return pixels


# --- writing


class Writer:
    """A little-endian bit stream in the making: values and their numbers of bits."""

    def __init__(self):
        self.value, self.n, self.parts = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def array(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Append values of at most 64 bits each."""
        cut = range(0, self.n, 32)
        head = np.array([self.value >> k & 0xFFFFFFFF for k in cut], np.uint64)
        self.parts += [(head, np.array([min(32, self.n - k) for k in cut], np.int64)), (values.astype(np.uint64), sizes.astype(np.int64))]
        self.value = self.n = 0

    def bytes(self) -> bytes:
        self.array(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        value, size = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        value, size = value[size > 0], size[size > 0]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        word, shift = (end - size) >> 6, ((end - size) & 63).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out = np.zeros((total >> 6) + 2, "<u8")
        out[word[first]] = np.bitwise_or.reduceat(value << shift, first)
        over = np.flatnonzero(shift.astype(np.int64) + size > 64)  # each word has one at most that goes on in the next
        out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
        return out.tobytes()[: (total + 7) >> 3]


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols, extra bits' values and their numbers for lengths or distances."""
    v = value - 1
    n = np.where(v < 4, 0, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64) - 1)
    return np.where(v < 4, v, 2 * n + 2 + (v >> n & 1)), np.where(v < 4, 0, v & ((1 << n) - 1)), n


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code for these counts, optimal unless some would be above most."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    n = counts[used].astype(np.int64)
    while True:
        order = np.argsort(n, kind="stable")
        weight, k = n[order].tolist(), len(used)
        up, leaf, inner = [0] * (2 * k - 1), 0, k
        for new in range(k, 2 * k - 1):  # leaves and inner nodes both ascend
            total = 0
            for _ in (0, 1):
                if leaf < k and (inner >= new or weight[leaf] <= weight[inner]):
                    pick, leaf = leaf, leaf + 1
                else:
                    pick, inner = inner, inner + 1
                up[pick] = new
                total += weight[pick]
            weight.append(total)
        depth = [0] * (2 * k - 1)
        for i in range(2 * k - 3, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth[:k]) <= most:
            out[used[order]] = depth[:k]
            return out
        n = n // 2 + 1  # flatter


def put_simple(w: Writer, symbol: int) -> None:
    w.put(1, 1)
    w.put(0, 1)
    w.put(1, 1)
    w.put(symbol, 8)


@functools.lru_cache(4096)
def normal_code(lengths: bytes) -> tuple[int, int]:
    """The bits (value, number) that describe a code by its symbols' lengths, two of which at least aren't 0."""
    own = np.frombuffer(lengths, np.uint8).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
    steps: list[tuple[int, int, int]] = []  # (code-length symbol, extra, extra bits)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        s, left = int(own[a]), b - a
        if s:
            steps.append((s, 0, 0))
            left -= 1
        while left:
            m = min(left, 6 if s else 138)
            if m < 3:
                steps += [(s, 0, 0)] * m
            elif s:
                steps.append((16, m - 3, 2))
            else:
                steps.append((18, m - 11, 7) if m >= 11 else (17, m - 3, 3))
            left -= m
    counts = np.bincount([s for s, _, _ in steps], minlength=19)
    if np.count_nonzero(counts) == 1:
        counts[0 if not counts[0] else 1] = 1
    sizes = code_lengths(counts, 7)
    used, codes = reversed_codes(sizes)
    code = dict(zip(used.tolist(), codes.tolist(), strict=True))
    order = [int(sizes[s]) for s in CODE_LENGTH_ORDER]
    last = max(4, max(k for k, x in enumerate(order) if x) + 1)
    w = Writer()
    w.put(0, 1)
    w.put(last - 4, 4)
    for x in order[:last]:
        w.put(x, 3)
    w.put(0, 1)
    for s, extra, k in steps:
        w.put(code[s], int(sizes[s]))
        w.put(extra, k)
    return w.value, w.n


def put_code(w: Writer, counts: np.ndarray, most: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Write the best code for counts of symbols; (codes with the first bit lowest, sizes) by symbol."""
    used = np.flatnonzero(counts)
    if len(used) < 2 and (not len(used) or used[0] < 256):
        put_simple(w, int(used[0]) if len(used) else 0)
        return (np.zeros(len(counts), np.int64),) * 2
    if len(used) < 2:
        counts = counts.copy()
        counts[0] = 1
    sizes = code_lengths(counts, most)
    w.put(*normal_code(sizes.astype(np.uint8).tobytes()))
    codes = np.zeros(len(counts), np.int64)
    used, own = reversed_codes(sizes)
    codes[used] = own
    return codes, sizes


WINDOW, LONGEST = 16, 4096  #: bytes that a back-reference has at least and at most
_ODD = np.uint64(0x9E3779B97F4A7C15)


def matches(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """(at, length, distance) of stretches that begin with a word and occurred earlier, as far as they agree."""
    n = len(samples)
    if n < 2 * WINDOW:
        return []
    starts = np.flatnonzero((samples[: n - WINDOW] == 32) | (samples[: n - WINDOW] == 10)) + 1
    words = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(samples), strides=(1,))
    h = (words[starts] * _ODD) ^ (words[starts + 8] * _ODD >> np.uint64(7))
    order = np.argsort(h, kind="stable")
    again = np.flatnonzero(h[order][1:] == h[order][:-1])
    if not len(again):
        return []
    late, early = starts[order[again + 1]], starts[order[again]]
    by = np.argsort(late)
    out, at = [], 0
    for c, p in zip(late[by].tolist(), early[by].tolist(), strict=True):
        if c < at:
            continue
        size, step = 0, 64
        while c + size < n:
            differ = samples[c + size : c + size + step] != samples[p + size : p + size + min(step, n - c - size)]
            if differ.any():
                size += int(differ.argmax())
                break
            size, step = size + len(differ), step * 4
        if size >= WINDOW:
            out.append((c, size, c - p))
            at = c + size
    return out


def put_image(w: Writer, samples: np.ndarray, refer: bool = True, main: bool = True) -> None:
    """An entropy-coded image of 8-bit samples in green; red and blue 0, alpha 255."""
    w.put(0, 1)  # no colour cache
    if main:
        w.put(0, 1)  # one group of codes
    found = [(a + k, min(LONGEST, size - k), d) for a, size, d in (matches(samples) if refer else []) for k in range(0, size, LONGEST)]
    symbol, at = samples.astype(np.int64), None
    if found:
        at, size, distance = (np.array(x) for x in zip(*found, strict=True))
        keep = np.ones(len(samples) + 1, np.int8)
        inside = np.zeros(len(samples) + 1, np.int32)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + size, -1)
        keep = np.cumsum(inside)[:-1] == 0
        keep[at] = True
        s, extra, bits = prefix_of(size)
        t, far_extra, far_bits = prefix_of(distance + 120)
        symbol[at] = 256 + s
        place = (np.cumsum(keep) - 1)[at]
        symbol = symbol[keep]
    codes, sizes = put_code(w, np.bincount(symbol, minlength=280))
    for x in (0, 0, 255):
        put_simple(w, x)
    far_codes, far_sizes = put_code(w, np.bincount(t, minlength=40) if found else np.zeros(40, np.int64))
    value, many = codes[symbol].astype(np.uint64), sizes[symbol]
    if found:
        for v, n in ((extra, bits), (far_codes[t], far_sizes[t]), (far_extra, far_bits)):
            value[place] |= v.astype(np.uint64) << many[place].astype(np.uint64)
            many[place] += n
    w.array(value, many)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def riff(*parts: bytes) -> bytes:
    body = b"".join(parts)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def encode_gray(data: bytes, width: int, rows: int = 16384) -> bytes:
    """A lossless WebP file of 8-bit samples (a multiple of width); with more than `rows` rows, one of several frames."""
    step = rows * width
    if len(data) <= step:
        return riff(chunk(b"VP8L", gray_stream(data, width)))
    three = lambda x: struct.pack("<I", x)[:3]
    parts = [chunk(b"VP8X", b"\x02\0\0\0" + three(width - 1) + three(rows - 1)), chunk(b"ANIM", bytes(6))]
    for at in range(0, len(data), step):
        part = data[at : at + step]
        place = bytes(6) + three(width - 1) + three(len(part) // width - 1) + three(0) + b"\x02"
        parts.append(chunk(b"ANMF", place + chunk(b"VP8L", gray_stream(part, width))))
    return riff(*parts)


def gray_stream(data: bytes, width: int) -> bytes:
    """The bit stream of one image; up to 16 different samples make a palette."""
    height = len(data) // width
    w = Writer()
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        w.put(value, n)
    samples = np.frombuffer(data, np.uint8)
    colours = np.flatnonzero(np.bincount(samples, minlength=256))
    few = len(colours) <= 16
    if few:
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(colours) - 1, 8)
        put_table(w, colours)
        shift = bundling(len(colours))
        each, per = 8 >> shift, 1 << shift
        index = np.searchsorted(colours, samples).reshape(height, width)
        index = np.pad(index, ((0, 0), (0, -width % per))).reshape(height, -1, per)
        samples = (index << np.arange(per) * each).sum(-1).astype(np.uint8).ravel()
    w.put(0, 1)
    put_image(w, samples, refer=not few)
    return w.bytes()


def put_table(w: Writer, colours: np.ndarray) -> None:
    """A palette of gray-in-green colours, as differences; alpha is 255 in the first and differs by 0 after it."""
    step = np.diff(colours.astype(np.int64), prepend=0) & 255
    w.put(0, 1)
    codes, sizes = put_code(w, np.bincount(step, minlength=280))
    put_simple(w, 0)
    put_simple(w, 0)
    if len(colours) == 1:
        put_simple(w, 255)
    else:  # two symbols, 0 and 255
        w.put(0b11, 2)
        w.put(0, 1)
        w.put(0, 1)
        w.put(255, 8)
    put_simple(w, 0)
    for i, s in enumerate(step.tolist()):
        w.put(int(codes[s]), int(sizes[s]))
        if len(colours) > 1:
            w.put(int(i == 0), 1)
