"""Gray-order hierarchical index over fingerprints of one or more 64-bit words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .components import local_roots, nearest_forest

FAN_OUT = 8
PAIRS_AT_ONCE = 250_000


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def gray_ranks(words: list[np.ndarray]) -> list[np.ndarray]:
    """Ranks of patterns of several words, first word first: an odd number of ones before turns a word's order round."""
    out, odd = [], np.zeros(len(words[0]), np.uint64)
    for x in words:
        out.append(gray_rank(x) ^ (np.uint64(0) - odd))
        odd ^= np.bitwise_count(x).astype(np.uint64) & np.uint64(1)
    return out


def differing(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return sum(np.bitwise_count(x ^ y).astype(np.int64) for x, y in zip(a, b, strict=True))


class GrayIndex:
    """Fingerprints of several trees, each in its own Gray order; trees are numbered as their keys are sorted.

    `prints` is a list of words. `label` marks rows that need not meet; a node whose members all have one
    label holds it, so a whole group of them is passed over at once.
    """

    def __init__(self, tree: np.ndarray, prints: np.ndarray | list[np.ndarray], label: np.ndarray | None = None):
        words = [prints] if isinstance(prints, np.ndarray) else prints
        self.order = np.lexsort((*reversed(gray_ranks(words)), tree))
        own, held = tree[self.order], [w[self.order] for w in words]
        mark = np.arange(len(own)) if label is None else label[self.order]
        # Per level: first child (with an end mark), bits that all members share, their values, their label.
        full = [np.full(len(own), ~np.uint64(0)) for _ in words]
        self.levels = [(np.arange(len(own) + 1), full, held, mark)]
        while len(own) and np.any(own[1:] == own[:-1]):
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            place = np.arange(len(own)) - np.repeat(heads, np.diff(np.r_[heads, len(own)]))
            first = np.flatnonzero(place % FAN_OUT == 0)
            _, mask, value, mark = self.levels[-1]
            ones = [np.bitwise_and.reduceat(v & m, first) for v, m in zip(value, mask, strict=True)]
            zeros = [np.bitwise_and.reduceat(~v & m, first) for v, m in zip(value, mask, strict=True)]
            low, high = np.minimum.reduceat(mark, first), np.maximum.reduceat(mark, first)
            self.levels.append((np.r_[first, len(own)], [a | b for a, b in zip(ones, zeros, strict=True)], ones, np.where(low == high, low, -1)))
            own = own[first]

    def pairs(self, radius: int, roots: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that differ in at most `radius` bits and in their labels: of one tree, or of the given pairs of trees."""
        top = len(self.levels) - 1
        if roots is None:
            roots = (np.arange(len(self.levels[top][2][0])),) * 2
        todo = [(top, *roots)]
        while todo:
            level, a, b = todo.pop()
            if level == 0:
                keep = a != b
                if keep.any():
                    yield self.order[a[keep]], self.order[b[keep]]
                continue
            first = self.levels[level][0]
            wide = (first[a + 1] - first[a]) * (first[b + 1] - first[b])
            cuts = np.searchsorted(np.cumsum(wide), np.arange(PAIRS_AT_ONCE, wide.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE), side="left") + 1
            for part in np.split(np.arange(len(a)), np.unique(np.minimum(cuts, len(a)))):
                if len(part):
                    x, y = self._children(level, a[part], b[part])
                    _, mask, value, mark = self.levels[level - 1]
                    bits = sum(np.bitwise_count((v[x] ^ v[y]) & m[x] & m[y]) for v, m in zip(value, mask, strict=True))
                    near = (bits <= radius) & ((mark[x] != mark[y]) | (mark[x] < 0))
                    near &= (x < y) if level == 1 else (x <= y)
                    if near.any():
                        todo.append((level - 1, x[near], y[near]))

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.levels[level][0]
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        wide = na * nb
        k = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        per = np.repeat(nb, wide)
        return np.repeat(first[a], wide) + k // per, np.repeat(first[b], wide) + k % per


def spanning_links(index: GrayIndex, words: list[np.ndarray], label: np.ndarray, radius: int, roots=None) -> tuple[np.ndarray, np.ndarray]:
    """Links within `radius` that span all labels they join, the nearest of each lot of pairs first; labels count from 0.

    Pairs come in bounded lots; what earlier lots have joined is passed over, so only the forest is held.
    """
    n = int(label.max()) + 1 if len(label) else 0
    root, out_a, out_b = np.arange(n), [], []
    for a, b in index.pairs(radius, roots):
        x, y = root[label[a]], root[label[b]]
        new = x != y
        a, b, x, y = a[new], b[new], x[new], y[new]
        if len(a):
            own = nearest_forest(n, x, y, differing([w[a] for w in words], [w[b] for w in words]))
            out_a.append(a[own])
            out_b.append(b[own])
            root = local_roots(n, np.concatenate([x[own], np.arange(n)]), np.concatenate([y[own], root]))
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)
