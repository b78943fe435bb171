"""Prediction by partial matching over the bytes of normalised texts.

A text is its words (A-Z lower-cased) joined by one space and closed by a line end, the end
symbol; the bytes before a text count as line ends. The model is a trie of byte contexts up
to ORDER: a symbol's probability comes from the longest context in which it was seen, after
an escape from each longer one. Escapes follow method D (half a count of each distinct
symbol goes to the escape), and symbols seen in a longer context are excluded from shorter
ones. Below order 0 the bytes never seen share what is left.

Counts are gathered over all training texts. A node of the trie stays when its count is at
least a given number; as a node's suffix is at least as frequent, the trie stays closed under
suffixes. A context needs only its own nodes and those of its suffixes, so the trie can be dealt
out by the last bytes of the contexts.
"""

from __future__ import annotations

import numpy as np

from .words import _LOWER, spans

ORDER = 6
END = 10


def normalised(data: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows i..j: (bytes, first byte of each row and the end, then what spans() gives)."""
    b, start, end, first = spans(data, off, i, j)
    n = end - start
    words = np.diff(first)
    # each word takes one byte more: a space, or the row's end symbol after its last; an empty row just the end
    size = np.add.reduceat(np.append(n + 1, 0), np.minimum(first[:-1], len(n))) * (words > 0) + (words == 0) if len(words) else np.zeros(0, np.int64)
    row = np.concatenate([[0], np.cumsum(size)])
    out = np.full(row[-1], 0x20, np.uint8)
    shift = np.repeat(row[:-1], words) + np.concatenate([[0], np.cumsum(n + 1)])[:-1] - np.repeat(np.concatenate([[0], np.cumsum(n + 1)])[first[:-1]], words) if len(n) else np.zeros(0, np.int64)
    at = np.arange(n.sum()) + np.repeat(shift - np.concatenate([[0], np.cumsum(n)])[:-1], n) if len(n) else np.zeros(0, np.int64)
    src = np.arange(n.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(n)])[:-1], n) if len(n) else at
    out[at] = _LOWER[b[src]]
    out[row[1:] - 1] = END
    return out, row, b, start, end, first


def grams(text: np.ndarray, row: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Each byte with the `order` bytes before it, as one number (the byte itself lowest)."""
    pad = np.concatenate([np.full(order, END, np.uint8), text])
    g = np.zeros(len(text), np.int64)
    place = np.arange(len(text)) - np.repeat(row[:-1], np.diff(row))
    for k in range(order, -1, -1):
        c = pad[order - k : order - k + len(text)]
        g = (g << 8) | np.where(place < k, END, c)
    return g


def shares(g: np.ndarray, counts: np.ndarray, least: float, order: int = ORDER) -> list[tuple[np.ndarray, ...]]:
    """Per order k: kept nodes and counts, kept contexts and totals, of counted grams."""
    out = []
    for k in range(order + 1):
        key, back = np.unique(g & ((1 << (8 * (k + 1))) - 1), return_inverse=True)
        count = np.bincount(back, counts, len(key))
        ctx, back = np.unique(key >> 8, return_inverse=True)
        total = np.bincount(back, count, len(ctx))
        out.append((key[count >= least], count[count >= least], ctx[total >= least], total[total >= least]))
    return out


class Model:
    """tables[k]: (sorted k+1-byte numbers, counts, sorted k-byte contexts, totals) kept at order k."""

    def __init__(self, tables: list[tuple[np.ndarray, ...]]) -> None:
        self.key, self.context = [t[0] for t in tables], [t[2] for t in tables]
        self.count, self.total = [t[1].astype(np.float64) for t in tables], [t[3].astype(np.float64) for t in tables]
        self.kinds, self.kept, self.shadow = [], [], []
        for k, (key, count, ctx) in enumerate(zip(self.key, self.count, self.context)):
            back = np.searchsorted(ctx, key >> 8)
            self.kinds.append(np.bincount(back, minlength=len(ctx)).astype(np.float64))
            self.kept.append(np.bincount(back, count, len(ctx)))
            # what the symbols kept here weigh one order lower
            low = self._count(k - 1, key) if k else np.zeros(len(key))
            self.shadow.append(np.bincount(back, low, len(ctx)))

    @staticmethod
    def _at(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return i, keys[i] == x

    def _count(self, k: int, g: np.ndarray) -> np.ndarray:
        i, ok = self._at(self.key[k], g & ((1 << (8 * (k + 1))) - 1))
        return np.where(ok, self.count[k][i] if len(self.count[k]) else 0.0, 0.0)

    def log10(self, g: np.ndarray) -> np.ndarray:
        """Log probability of the lowest byte of each gram after the bytes above it."""
        out, todo = np.zeros(len(g)), np.arange(len(g))
        less, fewer = np.zeros(len(g)), np.zeros(len(g))  # weight and number of excluded symbols
        for k in range(len(self.key) - 1, -1, -1):
            if not len(self.key[k]):
                continue
            x = g[todo]
            i, known = self._at(self.context[k], (x & ((1 << (8 * (k + 1))) - 1)) >> 8)
            known &= self.kinds[k][i] > 0
            total = np.where(known, self.total[k][i] - less[todo], 0.0)
            kinds = self.kinds[k][i] - fewer[todo]
            use = total > 0.25
            c = self._count(k, x)
            hit = use & (c > 0)
            out[todo[hit]] += np.log10((c[hit] - 0.5) / total[hit])
            miss = use & ~hit
            escape = (self.total[k][i] - self.kept[k][i])[miss] + kinds[miss] / 2
            out[todo[miss]] += np.log10(escape / total[miss])
            less[todo], fewer[todo] = np.where(known, self.shadow[k][i], 0.0), np.where(known, self.kinds[k][i], 0.0)
            todo = todo[~hit]
        out[todo] -= np.log10(np.maximum(256 - fewer[todo], 1))
        return out
