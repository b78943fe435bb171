"""Vectorised word handling over Arrow string columns.

A word is a maximal run of bytes outside {0x20, 0x09-0x0D}; as those bytes never
occur inside a multi-byte UTF-8 character this equals the regular expression
``[^\\x20\\x09-\\x0D]+``. Null texts have no words. Nothing is ever cut: a long text
is one slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_pow = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_BASE ** i modulo 2**64 for i < n at least."""
    global _pow
    if len(_pow) < n:
        with np.errstate(over="ignore"):
            _pow = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 256) - 1, _BASE, np.uint64)]), dtype=np.uint64)
    return _pow


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def text_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null row has length 0."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    buf = col.buffers()
    off = np.frombuffer(buf[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None and buf[2].size else np.zeros(0, np.uint8)
    return data, off


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows i..j: (the slice's bytes, start, end, first word of each row and the end)."""
    base = off[i]
    b = data[base : off[j]]
    o = off[i : j + 1] - base
    solid = ~_WS[b]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    at = o[:-1][o[:-1] < o[1:]]  # a word never crosses rows
    begin[at] = solid[at]
    at = o[1:][o[:-1] < o[1:]] - 1
    stop[at] = solid[at]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return b, start, end, np.searchsorted(start, o)


def hash_words(b: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = end - start
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    solid = b[~_WS[b]]
    rel = np.arange(len(solid)) - np.repeat(first, n)
    p = powers(int(n.max()) + 1)
    with np.errstate(over="ignore"):
        h = np.add.reduceat((_BYTE[_LOWER] if lower else _BYTE)[solid] * p[rel], first)
        return mix(h + n.astype(np.uint64))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k items (the caller drops those that cross rows)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out *= _BASE
            out += h[i : i + n]
        return mix(out)
