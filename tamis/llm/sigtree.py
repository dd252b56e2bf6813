"""Signature trees over sets of hashes: links within a collection without comparing all pairs.

Leaves hold a few sets of similar size that have a smallest hash in common, where there are such. Every node has the OR of its sets' bitmaps and their range of sizes.
Two nodes are compared only if some pair of their sets could still be similar: sizes must be compatible, and
the bits in common, with what collisions may hide, must reach the smallest overlap that a link needs. Pairs
of sets that pass are compared in full, unless they are connected already.
"""

from __future__ import annotations

import numpy as np

NARROW, WIDE = 512, 65536  #: bits of a bitmap, at least four for an element of a set of middle size
LEAF = FAN = 16


class Forest:
    """Union and find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


class Tree:
    """levels[0] are the leaves; each node covers sets[first:last]."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        width = min(WIDE, max(NARROW, 1 << (4 * int(np.median(self.size)) - 1).bit_length()))
        bits = np.zeros((len(sets), width // 8), np.uint8)
        for i, s in enumerate(sets):
            own = np.zeros(width, np.uint8)
            own[(s % np.uint64(width)).astype(np.int64)] = 1
            bits[i] = np.packbits(own)
        self.bits = bits.view(np.uint64)
        self.slack = self.size - np.bitwise_count(self.bits).sum(1)
        n = -(-len(sets) // LEAF)
        cut = np.arange(n) * LEAF
        self.levels = [(cut, np.append(cut[1:], len(sets)), np.bitwise_or.reduceat(self.bits, cut), np.minimum.reduceat(self.size, cut), np.maximum.reduceat(self.size, cut), np.maximum.reduceat(self.slack, cut))]
        while len(self.levels[-1][0]) > 1:
            first, last, bits, low, high, slack = self.levels[-1]
            cut = np.arange(-(-len(first) // FAN)) * FAN
            self.levels.append((first[cut], last[np.append(cut[1:], len(first)) - 1], np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut)))


def links(sets: list[np.ndarray], percent: int, forest: Forest | None = None, one: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified links (positions in sets) that connect what is connected; sets: sorted, distinct, not empty.

    Sets i and j are linked when 100 * common >= percent * all. With `one` (True or False for each set), only
    pairs of two different values are compared.
    """
    size, least = np.array([len(s) for s in sets]), np.array([s[0] for s in sets], np.uint64)
    order = np.lexsort((size, least, np.floor(np.log2(size) * 2.5)))
    tree = Tree([sets[i] for i in order])
    forest = forest or Forest(len(sets))
    side = one[order] if one is not None else None
    found: list[tuple[int, int]] = []
    need = lambda a, b: -(-percent * (a + b) // (100 + percent))  # noqa: E731  smallest overlap of sets of these sizes

    def roots(a: int, b: int) -> np.ndarray:
        return np.array([forest.find(int(order[k])) for k in range(a, b)])

    def leaves(i: int, j: int) -> None:
        first, last = tree.levels[0][:2]
        a, b, c, d = int(first[i]), int(last[i]), int(first[j]), int(last[j])
        x, y = roots(a, b), roots(c, d)
        able = x[:, None] != y[None, :]
        if side is not None:
            able &= side[a:b, None] != side[None, c:d]
        if i == j:
            able &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
        if not able.any():
            return
        n, m = tree.size[a:b, None], tree.size[None, c:d]
        least = need(n, m)
        able &= np.minimum(n, m) >= least
        common = np.bitwise_count(tree.bits[a:b, None] & tree.bits[None, c:d]).sum(-1)
        able &= common + np.minimum(tree.slack[a:b, None], tree.slack[None, c:d]) >= least
        for k, l in np.argwhere(able).tolist():
            p, q = int(order[a + k]), int(order[c + l])
            if forest.find(p) == forest.find(q):
                continue
            u, v = sets[p], sets[q]
            if len(u) > len(v):
                u, v = v, u
            at = np.searchsorted(v, u)
            both = int((v[np.minimum(at, len(v) - 1)] == u).sum())
            if 100 * both >= percent * (len(u) + len(v) - both):
                forest.join(p, q)
                found.append((p, q))

    todo = [(len(tree.levels) - 1, 0, 0)]
    while todo:
        level, i, j = todo.pop()
        first, last, bits, low, high, slack = tree.levels[level]
        if i != j:
            least = need(low[i], low[j])
            if min(high[i], high[j]) < least or max(low[i], low[j]) * percent > 100 * min(high[i], high[j]) or int(np.bitwise_count(bits[i] & bits[j]).sum()) + min(slack[i], slack[j]) < least:
                continue
            if level and (r := roots(int(first[i]), int(last[i])))[0] == r[-1] and (r == r[0]).all() and (roots(int(first[j]), int(last[j])) == r[0]).all():
                continue
        if not level:
            leaves(i, j)
            continue
        below = len(tree.levels[level - 1][0])
        a, b = range(i * FAN, min(below, (i + 1) * FAN)), range(j * FAN, min(below, (j + 1) * FAN))
        todo += [(level - 1, x, y) for x in a for y in b if x <= y][::-1] if i == j else [(level - 1, x, y) for x in a for y in b]
    return found
