"""A wavelet matrix: one bit-plane per bit of a symbol, with rank and select.

Plane 0 holds the highest bit of the symbols in their order; each next plane holds the next
bit after a stable partition by the bit before (zeros first). Access, counting of a symbol
before a position, and the place of its j-th occurrence cost one rank or select per plane.
All methods take and return numpy arrays.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np


class Bits:
    """A bit vector with counts of ones before each 64-bit word."""

    def __init__(self, packed: np.ndarray, n: int) -> None:
        self.n = n
        words = np.zeros((n >> 6) + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.zeros_before = np.arange(len(words) + 1, dtype=np.int64) * 64 - self.before

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        return cls(np.packbits(bits, bitorder="little"), len(bits))

    def packed(self) -> np.ndarray:
        return self.words.view(np.uint8)[: (self.n + 7) >> 3]

    def all(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i (0..n)."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)

    def select(self, bit: int, j: np.ndarray) -> np.ndarray:
        """Position of the j-th (from 0) one or zero."""
        before = self.before if bit else self.zeros_before
        w = np.searchsorted(before, j, "right") - 1
        left = (j - before[w]).astype(np.int64)
        word = self.words[w] if bit else ~self.words[w]
        rows = np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return w * 64 + np.argmax(np.cumsum(rows, axis=1) > left[:, None], axis=1)


class WaveletMatrix:
    def __init__(self, planes: list[Bits], n: int) -> None:
        self.planes, self.n = planes, n
        self.zeros = [p.n - int(p.before[-1]) for p in planes]

    @classmethod
    def of(cls, symbols: np.ndarray, bits: int) -> WaveletMatrix:
        planes, a = [], symbols.astype(np.uint16) if bits <= 16 else symbols
        for level in range(bits - 1, -1, -1):
            bit = ((a >> level) & 1).astype(bool)
            planes.append(Bits.of(bit))
            a = np.concatenate([a[~bit], a[bit]])
        return cls(planes, len(symbols))

    def symbols(self) -> np.ndarray:
        """All symbols in order: the partitions undone from the last plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for level, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1])):
            bit = plane.all()
            up = np.empty_like(a)
            up[~bit] = a[:zeros]
            up[bit] = a[zeros:] | kind(1 << level)
            a = up
        return a.astype(np.uint32)

    def access(self, i: np.ndarray) -> np.ndarray:
        i, out = np.asarray(i, np.int64), np.zeros(len(i), np.int64)
        for plane, zeros in zip(self.planes, self.zeros):
            bit, ones = plane.get(i), plane.rank1(i)
            i = np.where(bit, zeros + ones, i - ones)
            out = out * 2 + bit
        return out

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before position i."""
        at, start = i, self._start(symbol)
        top = len(self.planes) - 1
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            ones = plane.rank1(at)
            at = np.where((symbol >> (top - level)) & 1, zeros + ones, at - ones)
        return at - start

    def _start(self, symbol: np.ndarray) -> np.ndarray:
        """First place of each symbol's block in the last order."""
        if not hasattr(self, "starts"):
            every = np.arange(1 << len(self.planes))
            self.starts = self._walk(every, np.zeros_like(every), np.zeros_like(every))[0]
        return self.starts[symbol]

    def _walk(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place of the symbol's block in the last order, occurrences in lo..hi)."""
        top = len(self.planes) - 1
        at = np.stack([lo, hi])
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            ones = plane.rank1(at)
            at = np.where((symbol >> (top - level)) & 1, zeros + ones, at - ones)
        return at[0], at[1] - at[0]

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of symbol before lo and before hi."""
        n = len(lo)
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return both[:n], both[n:]

    def count(self, symbol: np.ndarray) -> np.ndarray:
        return self.rank(symbol, np.full(len(symbol), self.n, np.int64))

    def locate(self, symbol: int, j: np.ndarray) -> np.ndarray:
        """Positions of the j-th (from 0) occurrences of a symbol."""
        one = np.array([symbol], np.int64)
        i = self._walk(one, np.zeros(1, np.int64), np.zeros(1, np.int64))[0] + np.asarray(j, np.int64)
        for level, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1])):
            bit = (symbol >> level) & 1
            i = plane.select(bit, i - zeros if bit else i)
        return i

    def dump(self) -> bytes:
        """n, number of planes, then of each plane the length of its deflated bits and these."""
        out = [struct.pack("<QI", self.n, len(self.planes))]
        for p in self.planes:
            data = zlib.compress(p.packed().tobytes(), 1)
            out += [struct.pack("<I", len(data)), data]
        return b"".join(out)

    @classmethod
    def load(cls, data: memoryview) -> tuple[WaveletMatrix, int]:
        """The matrix and the bytes read."""
        n, bits = struct.unpack_from("<QI", data)
        at, planes = 12, []
        for _ in range(bits):
            (size,) = struct.unpack_from("<I", data, at)
            planes.append(Bits(np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + size]), np.uint8), n))
            at += 4 + size
        return cls(planes, n), at
