"""A minimal perfect hash over 128-bit keys, in levels of bits, for whole arrays.

Each level throws the keys that are left at a row of bits; a bit that one key alone hits is set and
that key is placed, all others go to the next level. A key's number is the count of set bits before
its own, so n keys have the numbers 0 to n - 1; about three bits a key, whatever the keys are. A key
that was never placed may get a number too: a fingerprint kept at it tells.
"""

from __future__ import annotations

import numpy as np

from .words import mix

ROOM = 1.5  # bits of a level for each key that is left


def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(lo + np.uint64(level)) ^ (hi * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(size)


class PerfectHash:
    def __init__(self, bits: np.ndarray, sizes: np.ndarray) -> None:
        """bits: words of 64; sizes: bits of each level, whole words."""
        self.bits, self.sizes = bits, sizes
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @staticmethod
    def of(hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        """Of distinct keys (two halves, uint64)."""
        left, bits, sizes = np.arange(len(hi)), [], []
        while len(left):
            size = 64 * (1 + int(ROOM * len(left)) // 64)
            at = _place(hi[left], lo[left], len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        return PerfectHash(np.concatenate([*bits, np.zeros(0, "<u8")]), np.array(sizes, np.int64))

    def numbers(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where no level has its bit."""
        out, todo, base = np.full(len(hi), -1, np.int64), np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _place(hi[todo], lo[todo], level, size).astype(np.int64) + base
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below)
            todo, base = todo[~hit], base + size
        return out
