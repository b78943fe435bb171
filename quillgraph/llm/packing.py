"""Packing documents into sequences by order-preserving dynamic programming.

The ids of a run of documents (ascending doc_id) form one line. It may be cut at document
ends, at sentence ends (a cost each) and, where a sentence is long, on a grid inside it (a
higher cost). f(j), the least cost of the line up to cut j, is

    f(j) = cut cost(j) + min over i with c_j - c_i <= size of f(i) + padding(c_j - c_i)

where padding(n) is size - n, or 0 for a power of two. The first form needs the least
f(i) + c_i over a sliding window, which a monotone queue holds; the powers of two are
eleven more places to look at. Every id lies in exactly one piece, whatever the cuts.

A run has RUN_TOKENS ids or more, so its unfinished last sequence costs at most 1 in 256.
Documents are dealt by ranges of doc_id and never meet in one task beyond a run.

Defined results: null or empty text is one piece with the end id; repeated rows are
documents of their own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens as T
from .store import parts
from .tokenfile import NULL, encoded, token_batches

SIZE = 1024
RUN_TOKENS = 1 << 18
SENTENCE, INSIDE = 4.0, 24.0  # costs of a cut, in ids of padding
LONG, GRID = 64, 32  # sentences of more ids get cuts on this grid

COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def choose_cuts(at: np.ndarray, cost: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Positions (0 first, the end last) that minimise padding plus cut costs.

    at: allowed cuts, ascending from 0 to the end, at most size apart; cost: of each."""
    m = len(at)
    exact: list[list[int]] = [[] for _ in range(m)]
    for k in range(size.bit_length()):
        if (1 << k) <= size:
            want = at - (1 << k)
            i = np.searchsorted(at, want)
            for j in np.flatnonzero((want >= 0) & (at[np.minimum(i, m - 1)] == want)).tolist():
                exact[j].append(int(i[j]))
    c, w = at.tolist(), cost.tolist()
    f, back = [0.0] * m, [0] * m
    queue: deque[int] = deque([0])
    key = [0.0] * m  # f(i) + c_i
    for j in range(1, m):
        cj = c[j]
        while c[queue[0]] < cj - size:
            queue.popleft()
        i = queue[0]
        best = key[i] + size - cj
        for e in exact[j]:
            if f[e] < best:
                best, i = f[e], e
        f[j], back[j] = best + w[j], i
        key[j] = k = f[j] + cj
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    out, j = [m - 1], m - 1
    while j:
        j = back[j]
        out.append(j)
    return at[out[::-1]]


def allowed_cuts(ids: np.ndarray, edges: np.ndarray, ends: np.ndarray, begins: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of a line of ids with documents between edges: positions and costs."""
    cost = np.full(len(ids) + 1, np.inf)
    if len(ids) > 1:
        cost[1:-1][ends[ids[:-1]] & begins[ids[1:]]] = SENTENCE
    cost[edges] = 0.0
    at = np.flatnonzero(cost < np.inf)
    grid, most = min(GRID, size), min(LONG, size)
    far = np.flatnonzero(np.diff(at) > most)
    n = (at[far + 1] - at[far] - 1) // grid
    more = np.repeat(at[far], n) + grid * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
    cost[more] = INSIDE
    at = np.flatnonzero(cost < np.inf)
    return at, cost[at]


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    unless keep_ids is false, ids."""
    path = path or T.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = T.encoder(path).tok
        vocab = tok.get_vocab()
        begins, ends = np.zeros(max(vocab.values()) + 1, bool), np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            begins[i], ends[i] = piece[0] in "ĠĊ", piece[-1] in ".!?Ċ"
        held: list[tuple] = []
        total = sequences = 0

        def pieces() -> pa.RecordBatch:
            nonlocal sequences
            part = held[0][0]
            doc, n, ids = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            edges = np.concatenate([[0], np.cumsum(n)])
            cuts = choose_cuts(*allowed_cuts(ids, edges, ends, begins, size), size)
            a = np.union1d(edges, cuts)
            a, b = a[:-1], a[1:]
            d, s = np.searchsorted(edges, a, "right") - 1, np.searchsorted(cuts, a, "right") - 1
            little = ids.astype("<u4")
            crc = np.fromiter((zlib.crc32(little[x:y].data) for x, y in zip(a.tolist(), b.tolist())), np.int64, len(a))
            cols = [pa.array(doc[d], pa.int64(), mask=doc[d] == NULL), *(pa.array(x, pa.int64()) for x in (a - edges[d], b - a, crc, n[d], (np.int64(part) << 40) + sequences + s, a - cuts[s]))]
            names = [x.split()[0] for x in COLUMNS.split(", ")]
            if keep_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(a, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            sequences += len(cuts) - 1
            return pa.RecordBatch.from_arrays(cols, names)

        for x in token_batches(batches, path):
            held.append(x)
            total += len(x[3])
            if total >= RUN_TOKENS:
                yield pieces()
                held, total = [], 0
        if held:
            yield pieces()

    return encoded(docs, parts(docs.sparkSession)).mapInArrow(run, COLUMNS + ", ids array<int>" * keep_ids)
