"""A hash table over whole arrays."""

from __future__ import annotations

import numpy as np


class Table:
    """A growing map from 63-bit keys to floats, probed for whole arrays."""

    def __init__(self, bits: int = 22) -> None:
        self.mask, self.used, self.shift = (1 << bits) - 1, 0, np.uint64(64 - bits)
        self.key, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits)

    def _slot(self, x: np.ndarray) -> np.ndarray:
        """The top bits of a product, which all bits of x move."""
        with np.errstate(over="ignore"):
            return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Values, nan where unknown. A key k is kept as k + 1."""
        out, want = np.full(len(x), np.nan), x.astype(np.uint64) + np.uint64(1)
        todo, slot = None, self._slot(x)
        while True:
            k = self.key[slot]
            hit = k == (want if todo is None else want[todo])
            if todo is None:
                out[hit] = self.value[slot[hit]]
            else:
                out[todo[hit]] = self.value[slot[hit]]
            go = np.flatnonzero(~hit & (k != 0))
            if not len(go):
                return out
            todo, slot = go if todo is None else todo[go], (slot[go] + 1) & self.mask

    def add(self, x: np.ndarray, values: np.ndarray) -> None:
        """Distinct unknown keys; when more than half full nothing is added."""
        if self.used + len(x) > self.mask // 2:
            return
        self.used += len(x)
        todo, slot = np.arange(len(x)), self._slot(x)
        while len(todo):
            won = np.zeros(len(todo), bool)
            won[np.unique(slot, return_index=True)[1]] = True
            won &= self.key[slot] == 0
            self.key[slot[won]], self.value[slot[won]] = x[todo[won]].astype(np.uint64) + np.uint64(1), values[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask
