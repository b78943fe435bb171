"""An FM-index over integer strings: wavelet-matrix BWT, backward search, matching statistics.

Strings are concatenated, each followed by a separator of its own; a weight tells how many
identical strings one stands for. `matching` streams queries through the index in lock step:
from right to left it keeps, for each query, the suffix-array interval of the longest prefix
of what lies right of the cursor that occurs at least twice (by weight); a failed backward
step moves the interval to its parent in the LCP interval tree.
"""

from __future__ import annotations

import numpy as np

from .wavelet import WaveletMatrix


def suffix_array(s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling and LCP array; no two suffixes share over `most` symbols."""
    n, base = len(s), int(s.max(initial=0)) + 2
    width = 3 if base < 1 << 20 else 1  # three symbols in one key, where they fit
    key = np.zeros(n, np.int64)
    for k in range(width):
        key *= base
        key[: n - k] += s[k:] + 1
    rank = np.unique(key, return_inverse=True)[1].astype(np.int32)
    ranks = [(width, rank)]
    while width <= most and rank.max(initial=0) < n - 1:
        key = rank.astype(np.int64) * (n + 1)
        key[: n - width] += rank[width:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int32)
        width *= 2
        ranks.append((width, rank))
    if rank.max(initial=0) == n - 1:
        sa = np.empty(n, np.int64)
        sa[rank] = np.arange(n)
    else:
        sa = np.argsort(rank, kind="stable")
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(n + 1, np.int64)
    for w, by in [*ranks[::-1], (1, s), (1, s)]:  # each width fits once, single symbols twice
        ok = (a < n) & (b < n)
        ok[ok] = by[a[ok]] == by[b[ok]]
        lcp[1:n][ok] += w
        a[ok] += w
        b[ok] += w
    return sa, lcp


class FMIndex:
    def __init__(self, strings: list[np.ndarray], weights: np.ndarray) -> None:
        """strings: arrays of symbols >= 1 (any integers below 2**31)."""
        length = np.array([len(x) for x in strings])
        self.alphabet, coded = np.unique(np.concatenate(strings), return_inverse=True)
        k = len(strings)
        n = int(length.sum()) + k
        text = np.zeros(n, np.int64)
        ends = np.cumsum(length + 1) - 1
        text[ends] = np.arange(k)  # separators 0..k-1, each once
        inner = np.ones(n, bool)
        inner[ends] = False
        text[inner] = coded + k
        sa, self.lcp = suffix_array(text, int(length.max()) + 1)
        bwt = text[sa - 1]  # of the first suffix the last separator, which never extends a match
        sep = np.maximum(bwt - k + 1, 0)  # all separators are one symbol to the index
        bits = max(1, len(self.alphabet).bit_length())
        self.bwt = WaveletMatrix.of(sep.astype(np.uint32), bits)
        counts = np.bincount(sep, minlength=len(self.alphabet) + 1)
        # suffixes that begin with a separator come first, then by symbol
        self.first = np.concatenate([[0, k], k + np.cumsum(counts[1:])]) if len(counts) > 1 else np.array([0, k])
        owner = np.searchsorted(ends, sa)
        self.mass = np.concatenate([[0], np.cumsum(np.asarray(weights, np.int64)[owner])])
        self.n = n
        self._parents()

    def _parents(self) -> None:
        """Minima of the LCP array over all runs of 2**k, to find lower values on both sides."""
        self.lcp[0] = self.lcp[self.n] = -1
        kind = np.int16 if self.lcp.max() < 2**15 else np.int64
        self.low = [self.lcp.astype(kind)]
        while 2 << (len(self.low) - 1) <= self.n + 1:
            a, w = self.low[-1], 1 << (len(self.low) - 1)
            self.low.append(np.minimum(a[:-w], a[w:]))

    def _parent(self, edge: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The widest interval around a boundary whose inner LCP values are at least `depth`."""
        lo, hi = edge.copy(), edge.copy()
        for k in range(len(self.low) - 1, -1, -1):
            w, low = 1 << k, self.low[k]
            at = lo - w  # values lo-w .. lo-1
            go = (at >= 0) & (low[np.maximum(at, 0)] >= depth)
            lo[go] -= w
            go = (hi + w < self.n + 1) & (low[np.minimum(hi + 1, len(low) - 1)] >= depth)  # hi+1 .. hi+w
            hi[go] += w
        return lo - 1, hi + 1

    def code(self, x: np.ndarray) -> np.ndarray:
        """Symbols as the index knows them (all must occur in it)."""
        return np.searchsorted(self.alphabet, x) + 1

    def matching(self, queries: list[np.ndarray], least: int = 2) -> list[np.ndarray]:
        """For each place of each query, the length of the longest match from there that has a
        weight of `least` or more in the index."""
        size = np.array([len(q) for q in queries])
        wide = int(size.max())
        grid = np.zeros((len(queries), wide), np.int64)
        flat = self.code(np.concatenate(queries))
        grid[np.arange(wide) >= wide - size[:, None]] = flat
        out = np.zeros((len(queries), wide), np.int64)
        lo, hi, depth = np.zeros(len(queries), np.int64), np.full(len(queries), self.n), np.zeros(len(queries), np.int64)
        for col in range(wide - 1, -1, -1):
            todo = np.flatnonzero(size >= wide - col)
            c = grid[todo, col]
            rare = self.mass[self.first[c + 1]] - self.mass[self.first[c]] < least
            lo[todo[rare]], hi[todo[rare]], depth[todo[rare]] = 0, self.n, 0  # nothing that begins here recurs
            todo = todo[~rare]
            while len(todo):
                c = grid[todo, col]
                a, b = (self.first[c] + x for x in self.bwt.ranks(c, lo[todo], hi[todo]))
                ok = self.mass[b] - self.mass[a] >= least
                lo[todo[ok]], hi[todo[ok]] = a[ok], b[ok]
                depth[todo[ok]] += 1
                todo = todo[~ok]
                todo = todo[depth[todo] > 0]  # at the root nothing is left to drop
                x, y = lo[todo], hi[todo]
                d = np.maximum(np.maximum(self.lcp[x], self.lcp[y]), 0)
                edge = np.where(self.lcp[x] == d, x, y)
                root = d == 0
                left, right = self._parent(edge, d)
                lo[todo], hi[todo] = np.where(root, 0, left), np.where(root, self.n, right)
                depth[todo] = d
            out[:, col] = depth
        return [out[i, wide - n :] for i, n in enumerate(size)]
