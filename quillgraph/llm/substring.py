"""Substring deduplication: words in windows that occur more than once anywhere.

A window is so many consecutive words of one text. Where it recurs, its lowest hashed
12-gram recurs at the same place in it; these lowest 12-grams (anchors) are counted first.
For an anchor that recurs, each run of windows with it as their lowest 12-gram is a string that
goes to the shard of the anchor, so that a window is in one string and equal windows meet. A shard
builds a compressed FM-index over all its distinct strings and streams them through it: the matching
statistics tell at each place how long a match occurs twice, and matches of a window's length are
reported as intervals of words to remove. Nothing but them says which words go.

Equal strings are one with a weight. The strings of an anchor with more than HOT places (a licence
line in a third of all texts) would fill one shard, so its windows travel one by one to the shard of
their own hash. Those whose first window - MARGIN words occur once, counted by a 64-bit hash with
partial sums, are left out before, as an anchor that occurs once is: they cannot recur, and of the others
the FM-index decides. Equal windows are one with a weight, with words from one of its places; what
the FM-index finds in it goes to all its places. Either way is exact but for collisions of 64-bit
hashes, by which words and texts are told apart too.

Defined results: a null text has no words; a window never spans two texts; windows are
judged on the input; rows are documents of their own, whether they repeat an id, lack one or repeat
a text; an empty table gives an empty result; texts of any length are whole; other columns are not
read by the query and come back unchanged, whatever their names, where texts are asked for, unless
one has the name of a result column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .mixing import spare_names
from .store import written
from .words import hash_words, slices, spans, text_column, windows

GRAM = 12
HOT = 200
SHARD_STRINGS = 10_000
RUN = 36  # windows in a string at most
MARGIN = 3


def _slide(f, x: np.ndarray, n: int) -> np.ndarray:
    """f over each n consecutive items."""
    width = 1
    while width * 2 <= n:
        x = f(x[:-width], x[width:])
        width *= 2
    return f(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def lowest(h: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of n-grams, the lowest of each window: 0 where none fits in a row); h: word hashes of
    rows that begin at first (and the end)."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    g = windows(h, gram) | np.uint64(1)
    low = _slide(np.minimum, g, window - gram + 1)
    fits = np.zeros(len(h) + 1, np.int64)
    n = np.diff(first)
    long = n >= window
    np.add.at(fits, first[:-1][long], 1)
    np.add.at(fits, first[:-1][long] + n[long] - window + 1, -1)
    return g, np.where(np.cumsum(fits)[: len(low)] > 0, low, np.uint64(0))


def anchors(h: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of n-grams that are the lowest of some window."""
    g, low = lowest(h, first, window, gram)
    if not len(low):
        return np.zeros(0, np.int64), g
    edge = np.zeros(window - gram, np.uint64)
    at = np.flatnonzero(_slide(np.maximum, np.concatenate([edge, low, edge]), window - gram + 1) == g)
    return at, g[at]


def _read(b: pa.RecordBatch, i: int, j: int, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw, start, end, first = spans(data, off, i, j)
    return hash_words(raw, start, end), first


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_column(b, "text")
            ids = b.column(b.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            for i, j in slices(off):
                h, first = _read(b, i, j, data, off)
                at, g = anchors(h, first, window, gram)
                row = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids[i + row]), pa.array((at - first[row]).astype(np.int32))], ["anchor", "doc_id", "at"])

    return run


def _strings(w: np.ndarray, low: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the windows w begin a string, words in it): runs with one anchor in one row."""
    begin = np.concatenate([[True], (np.diff(w) > 1) | (low[1:] != low[:-1]) | (row[1:] != row[:-1])])
    place = np.arange(len(w))
    begin |= (place - np.maximum.accumulate(np.where(begin, place, 0))) % RUN == 0
    k = np.flatnonzero(begin)
    return k, np.diff(np.append(k, len(w))) + window - 1


def _packed(h: np.ndarray, a: np.ndarray, size: np.ndarray) -> pa.Array:
    cut = np.concatenate([[0], np.cumsum(size)])
    words = h[np.arange(cut[-1]) + np.repeat(a - cut[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((cut * 8).astype(np.int32)), pa.py_buffer(words)])


def _send(window: int, gram: int, what: str):
    """From texts with a list of words: `cold`, strings of the windows with an anchor from there; `hot`,
    these windows hashed, and their beginnings; `again`, the words of windows that are asked for by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_column(b, "text")
            ids, copies = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("doc_id", "copies"))
            at = b.column(b.schema.get_field_index(what))
            items, edge = at.flatten(), np.concatenate([[0], np.cumsum([len(x) for x in at])])
            flat = (items.field("at") if what == "again" else items).to_numpy(zero_copy_only=False)
            for i, j in slices(off):
                if edge[j] == edge[i]:
                    continue
                h, first = _read(b, i, j, data, off)
                w = np.repeat(first[:-1], np.diff(edge[i : j + 1])) + flat[edge[i] : edge[j]]
                if what == "again":
                    own, n = (items.field(c).slice(edge[i], len(w)) for c in ("window", "copies"))
                    yield pa.RecordBatch.from_arrays([own, own, pa.array(np.zeros(len(w), np.int32)), n, _packed(h, w, np.full(len(w), window))], ["anchor", "doc_id", "at", "copies", "words"])
                    continue
                g, low = lowest(h, first, window, gram)
                known = np.unique(g[w])
                w = np.flatnonzero(known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low)
                row = np.searchsorted(first, w, "right") - 1
                if what == "hot":
                    kinds = [pa.array(windows(h, n)[w].view(np.int64)) for n in (window, window - MARGIN)]
                    yield pa.RecordBatch.from_arrays([*kinds, pa.array(ids[i:j][row]), pa.array((w - first[row]).astype(np.int32)), pa.array(copies[i:j][row])], ["window", "begin", "doc_id", "at", "copies"])
                    continue
                k, size = _strings(w, low[w], row, window)
                a, r = w[k], row[k]
                cols = [pa.array(low[a].view(np.int64)), pa.array(ids[i:j][r]), pa.array((a - first[r]).astype(np.int32)), pa.array(copies[i:j][r])]
                yield pa.RecordBatch.from_arrays([*cols, _packed(h, a, size)], ["anchor", "doc_id", "at", "copies", "words"])

    return run


def _runs(hit: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Intervals covered by windows that begin at the hits."""
    out: list[tuple[int, int]] = []
    for p in np.flatnonzero(hit).tolist():
        if out and out[-1][1] >= p:
            out[-1] = (out[-1][0], p + window)
        else:
            out.append((p, p + window))
    return out


def _search(window: int):
    def run(t: pa.Table) -> pa.Table:
        kinds: dict[bytes, int] = {}  # equal strings are one with a weight
        kind = np.array([kinds.setdefault(x.as_py(), len(kinds)) for x in t.column("words")])
        weight = np.bincount(kind, t.column("copies").to_numpy()).astype(np.int64)
        strings = [np.frombuffer(x, np.uint64) for x in kinds]
        spans_ = [_runs(m >= window, window) for m in FMIndex(strings, weight).matching(strings)]
        out = [(d, a + x, a + y) for d, a, k in zip(t.column("doc_id").to_pylist(), t.column("at").to_pylist(), kind.tolist()) for x, y in spans_[k]]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "a": pa.array(cols[1], pa.int32()), "b": pa.array(cols[2], pa.int32())})

    return run


def repeated(docs: DataFrame, window: int = 35, gram: int = GRAM) -> DataFrame:
    """Covered words (doc_id, a, b) of docs (doc_id, text), where equal texts, and only they, have the
    same id."""
    classes = written(docs.groupBy("doc_id").agg(F.count("*").alias("copies")), "texts")
    places = docs.mapInArrow(_anchor_rows(window, gram), "anchor long, doc_id long, at int")
    known = written(places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    of = places.join(known, "anchor").groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("n") <= HOT, F.col("at"))).alias("cold"), F.collect_set(F.when(F.col("n") > HOT, F.col("at"))).alias("hot")
    )
    of = written(of.join(classes, "doc_id"), "places")
    full = docs.dropDuplicates(["doc_id"]).join(of, "doc_id")  # copies meet before the shuffle
    string = "anchor long, doc_id long, at int, copies long, words binary"

    def searched(sent: DataFrame, n: int) -> DataFrame:
        dealt = sent.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-n // SHARD_STRINGS)))))
        return dealt.groupBy("shard").applyInArrow(_search(window), "doc_id long, a int, b int")

    cold = searched(full.where(F.size("cold") > 0).mapInArrow(_send(window, gram, "cold"), string), of.agg(F.sum(F.size("cold"))).first()[0] or 0)
    # written, so that a window in very many texts is a skewed side of the joins below, which can be split
    each = written(full.where(F.size("hot") > 0).mapInArrow(_send(window, gram, "hot"), "window long, begin long, doc_id long, at int, copies long"), "windows")
    begun = written(each.groupBy("begin").agg(F.sum("copies").alias("n")).where("n > 1").select("begin"), "begun")
    place = F.struct("doc_id", "at")
    kinds = written(each.join(begun, "begin").groupBy("window").agg(F.min(place).alias("place"), F.sum("copies").alias("copies")), "kinds")
    again = kinds.groupBy("place.doc_id").agg(F.collect_list(F.struct("place.at", "window", "copies")).alias("again"))
    sent = full.select("doc_id", "text", "copies").join(again, "doc_id").mapInArrow(_send(window, gram, "again"), string)
    # written, as a window in very many texts is a skewed side of the join with it
    found = written(searched(sent, kinds.count()).select(F.col("doc_id").alias("window")), "found")
    common = each.join(found, "window").select("doc_id", F.col("at").alias("a"), (F.col("at") + window).alias("b"))
    return cold.unionByName(common)


def _covered(spans_: list | None, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for s in spans_ or ():
        edge[s["a"]] += 1
        edge[s["b"]] -= 1
    return np.cumsum(edge)[:-1] > 0


def removed(docs: DataFrame, window: int = 35, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) with n_words, n_removed, kept_sha256 and, unless texts is false,
    kept (the kept words joined by one space). Without texts, only doc_id stays of docs."""
    added = ["n_words", "n_removed", "kept_sha256", "kept"] if texts else ["n_words", "n_removed", "kept_sha256"]
    keep = [c for c in docs.columns if c not in added] if texts else ["doc_id"]
    kinds, spare = dict(docs.dtypes), spare_names(docs)
    key, found = spare("text_key"), spare("spans")
    # a text goes by its hash: never null, the same for copies and only for them
    slim = docs.select(F.xxhash64("text").alias("doc_id"), "text").where("text IS NOT NULL")
    intervals = repeated(slim, window, gram)
    per = written(intervals.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("a", "b")).alias(found)), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in added]
            for text, hits in zip(b.column(b.schema.get_field_index("text")), b.column(b.schema.get_field_index(found))):
                words = (text.as_py() or "").encode().split()
                gone, kept = 0, words
                if hits.is_valid:
                    hit = _covered(hits.as_py(), len(words))
                    gone, kept = int(hit.sum()), compress(words, (~hit).tolist())
                kept = b" ".join(kept)
                for x, y in zip(out, (len(words), gone, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else "")):
                    x.append(y)
            cols = [b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, keep + added)

    wanted = list(dict.fromkeys([*keep, "text"]))
    full = docs.select(*(F.col(f"`{c}`") for c in wanted), F.xxhash64("text").alias(key)).join(per, key, "left").select(*(F.col(f"`{c}`") for c in wanted), found)
    return full.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_words long", "n_removed long", "kept_sha256 string", "kept string"][: len(added)]))
