"""Language-model scores of whole texts: a word-frequency base and a byte PPM model.

Both learn from all training rows, and all of what they count is kept. Texts are read in chunks,
which end when they hold KEYS distinct grams. A chunk sends its distinct grams and words with their
counts (0 where only held-out texts have them) to shards: one row per chunk and shard, the numbers
packed and compressed in it. The PPM trie is dealt out by the LOCAL bytes before a symbol: a shard
holds every longer context that ends in its own, adds up what the chunks sent, works out each
gram's log probability once and answers every chunk. Only the orders below LOCAL are the same for
all shards: nodes of at most LOCAL bytes, which 256 ** LOCAL bounds whatever the corpus. A chunk's
texts, normalised and compressed a slice to a row, are then scored beside the answers it got. So a task holds one chunk's grams or one shard's
distinct ones, never a whole corpus's; trie and vocabulary may be of any size, and no row stands
for a single gram. Log probabilities travel in single precision and are added up in double.

Defined results: null text is empty, scored as its end alone; rows that repeat an id are
documents of their own; a null id belongs to training; without training rows every count
is 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ppm
from .store import parts, small_batches, written
from .words import SLICE_BYTES, hash_words, mix, slices, spans, text_column

SHARE = 0.0
LOCAL = 3
KEYS = 2_000_000  # distinct grams after which a chunk ends
SHARD_BYTES = 8 << 20  # of text for one shard of grams
LOW_PARTS = 8
MESSAGE = 1 << 13  # keys at most in a row, and a sixteenth of the bytes of texts: rows of a few dozen KB
SPOOL = 32 << 20  # bytes of requests that a shard holds in memory; more wait in its task's scratch file
GRAM, WORD, LOW, ROW = 0, 1, 2, 3
_CODEC = pa.Codec("zstd", compression_level=1)


def squeezed(data: np.ndarray) -> bytes:
    return _CODEC.compress(np.ascontiguousarray(data), asbytes=True)


def plain(data: bytes, n: int) -> np.ndarray:
    """So many bytes from squeezed()."""
    return np.frombuffer(_CODEC.decompress(data, n), np.uint8)


def packed(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, compressed."""
    return squeezed(x.view(np.uint8).reshape(len(x), -1).T)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(plain(data, n * width).reshape(width, n).T).view(kind).ravel()


def packed_keys(key: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return packed(np.diff(key, prepend=0))


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n, np.int64))


def turned(g: np.ndarray, order: int, local: int) -> np.ndarray:
    """Grams with the `local` bytes before the symbol on top, which a shard has few of."""
    older = 8 * (order - local)
    context = (g >> 8) & ((1 << (8 * local)) - 1)
    return (context << (older + 8)) | (((g >> (8 * local + 8)) & ((1 << older) - 1)) << 8) | (g & 255)


def back(t: np.ndarray, order: int, local: int) -> np.ndarray:
    older = 8 * (order - local)
    return (((t >> 8) & ((1 << older) - 1)) << (8 * local + 8)) | ((t >> (older + 8)) << 8) | (t & 255)


class Tally:
    """Counts of 64-bit keys, ascending; at most WAIT of those added are not merged yet."""

    WAIT = 1_000_000

    def __init__(self) -> None:
        self.key, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, x: np.ndarray, counted: bool = True) -> None:
        if len(x):
            x = np.sort(x)
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            self.put(x[first], np.diff(np.append(first, len(x))) if counted else np.zeros(len(first), np.int64))

    def put(self, key: np.ndarray, n: np.ndarray) -> None:
        """Ascending distinct keys with counts."""
        self.parts.append((key, n))
        self.waiting += len(key)
        if self.waiting > self.WAIT:
            self.merge()

    def merge(self) -> None:
        if self.parts:
            key = np.concatenate([self.key, *(p[0] for p in self.parts)])
            n = np.concatenate([self.n, *(p[1] for p in self.parts)])
            self.parts, self.waiting = [], 0
            order = np.argsort(key, kind="stable")  # merges ascending runs
            key, n = key[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            self.key, self.n = key[first], np.add.reduceat(n, first)


NAMES = ["chunk", "kind", "part", "n", "keys", "numbers", "doc_ids", "held_out"]


def _columns(kind: str) -> str:
    return f"chunk long, kind int, part long, n long, keys binary, numbers binary, doc_ids array<{kind}>, held_out array<boolean>"


def _message(rows: list[tuple], like: pa.DataType, doc_ids: pa.Array | None = None, held_out: pa.Array | None = None) -> pa.RecordBatch:
    """Rows (chunk, kind, part, n, keys, numbers) between chunks and shards. A row of the kind ROW is a
    slice of texts instead: its bytes, its texts, the compressed bytes and the packed lengths of the texts."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    for of, kind in ((doc_ids, like), (held_out, pa.bool_())):
        cols.append(pa.nulls(len(rows), pa.list_(kind)) if of is None else pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of))
    return pa.RecordBatch.from_arrays(cols, NAMES)


def _dealt(chunk: int, kind: int, tally: Tally, part: np.ndarray, of: int) -> Iterator[tuple]:
    order = np.argsort(part.astype(np.uint16 if of < 1 << 16 else np.int64), kind="stable")
    part, key, n = part[order], tally.key[order], tally.n[order].astype(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(part)]):
        for x in range(a, z, MESSAGE):
            y = min(x + MESSAGE, z)
            yield chunk, kind, int(part[a]), y - x, packed_keys(key[x:y]), packed(n[x:y])


def _requests(order: int, local: int, shards: int, most: int):
    """All texts by chunk, and what each chunk asks of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        like = None
        grams, words = Tally(), Tally()

        def asked() -> Iterator[pa.RecordBatch]:
            nonlocal grams, words
            grams.merge()
            words.merge()
            low = Tally()
            some = grams.n > 0
            key, of = np.unique(back(grams.key[some], order, local) & ((1 << (8 * local)) - 1), return_inverse=True)
            low.put(key, np.bincount(of, grams.n[some], len(key)).astype(np.int64))
            low.merge()
            context = grams.key >> (8 * (order - local) + 8)
            for kind, t, by, of in ((GRAM, grams, context, shards), (WORD, words, words.key, shards), (LOW, low, low.key, LOW_PARTS)):
                held, size = [], 0
                for row in _dealt(chunk, kind, t, mix(by.astype(np.uint64)) % np.uint64(of), of):
                    held.append(row)
                    size += len(row[4]) + len(row[5])
                    if size > 1 << 20:
                        yield _message(held, like)
                        held, size = [], 0
                if held:
                    yield _message(held, like)
            grams, words = Tally(), Tally()

        for b in batches:
            data, off = text_column(b, "text")
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "held_out")]
            like = cols[0].type
            held = cols[1].to_numpy(zero_copy_only=False)
            for i, j in slices(off):
                text, row, raw, start, end, first = ppm.normalised(data, off, i, j)
                g, h, teaches = turned(ppm.grams(text, row, order), order, local), _words(raw, start, end), ~held[i:j]
                of_text, of_word = np.repeat(teaches, np.diff(row)), np.repeat(teaches, np.diff(first))
                for t, x, use in ((grams, g, of_text), (words, h, of_word)):
                    t.add(x[use])
                    t.add(x[~use], counted=False)
                for x, y in slices(row, MESSAGE << 4):
                    sent = (chunk, ROW, int(row[y] - row[x]), y - x, squeezed(text[row[x] : row[y]]), packed(np.diff(row[x : y + 1])))
                    yield _message([sent], like, *(c.slice(i + x, y - x) for c in cols))
                if len(grams.key) > most:
                    yield from asked()
                    chunk += 1
        if like is not None:
            yield from asked()

    return run


def _words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (hash_words(raw, start, end, lower=True) >> np.uint64(1)).view(np.int64)


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)) for c in NAMES[:6]]
        for r in range(b.num_rows):
            yield tuple(c[r].as_py() for c in cols)


def _by_part(m: tuple) -> tuple:
    return m[1:3]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part: distinct training keys, the sum of their counts and, of LOW, both themselves."""
    for (kind, _), group in groupby(_messages(batches), _by_part):
        t = Tally()
        for *_, n, keys, numbers in group:
            t.put(unpacked_keys(keys, n), unpacked(numbers, n, np.uint32).astype(np.int64))
        t.merge()
        both = [packed_keys(t.key), packed(t.n)] if kind == LOW else [None, None]
        cols = [[kind], [int((t.n > 0).sum())], [int(t.n.sum())], [both[0]], [both[1]]]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["kind", "kinds", "total", "keys", "numbers"])


def _answers(low, order: int, local: int, least: float):
    """Adds up what the chunks sent to each shard and answers each in its own order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal like
            for b in batches:
                like = b.column(b.schema.get_field_index("doc_ids")).type.value_type
                yield b

        for (kind, part), group in groupby(_messages(seen()), _by_part):
            t, asked = Tally(), 0
            with tempfile.SpooledTemporaryFile(max_size=SPOOL) as kept:
                for chunk, _, _, n, keys, numbers in group:
                    t.put(unpacked_keys(keys, n), unpacked(numbers, n, np.uint32).astype(np.int64))
                    pickle.dump((chunk, n, keys), kept)
                    asked += 1
                t.merge()
                value = t.n
                if kind == GRAM:
                    g, taught = back(t.key, order, local), t.n > 0
                    model = ppm.Model([*low.value, *ppm.shares(g[taught], t.n[taught], least, order)[local:]])
                    value = np.concatenate([model.log10(g[s : s + 200_000]) for s in range(0, len(g), 200_000)]).astype(np.float32)
                kept.seek(0)
                held, size = [], 0
                for _ in range(asked):
                    chunk, n, keys = pickle.load(kept)
                    held.append((chunk, kind, part, n, keys, packed(value[np.searchsorted(t.key, unpacked_keys(keys, n))])))
                    size += 2 * len(keys)
                    if size > 1 << 20:
                        yield _message(held, like)
                        held, size = [], 0
                if held:
                    yield _message(held, like)

    return run


class Known:
    """Answers to a chunk, looked up for whole arrays."""

    def __init__(self, kind: type) -> None:
        self.kind, self.parts = kind, []

    def put(self, n: int, keys: bytes, numbers: bytes) -> None:
        self.parts.append((unpacked_keys(keys, n), unpacked(numbers, n, self.kind)))

    def of(self, x: np.ndarray) -> np.ndarray:
        if len(self.parts) > 1:
            key, value = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
            order = np.argsort(key)
            self.parts = [(key[order], value[order])]
        out = np.zeros(len(x))
        if len(x):
            key, value = self.parts[0]
            order = np.argsort(x)
            s = x[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            out[order] = np.repeat(value[np.searchsorted(key, s[first])], np.diff(np.append(first, len(s))))
        return out


def _scores(order: int, local: int):
    """Per text: words and the end, words known from training, the sum of log10(c + 1) and the model's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chances, counts = None, None, None
        held: list[tuple] = []
        size = 0

        def scored() -> pa.RecordBatch:
            text, length = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            row = np.concatenate([[0], np.cumsum(length)])
            raw, start, end, first = spans(text, row, 0, len(length))
            score = np.add.reduceat(chances.of(turned(ppm.grams(text, row, order), order, local)), row[:-1])
            c = counts.of(_words(raw, start, end))
            weight, seen = np.concatenate([[0], np.cumsum(np.log10(c + 1))]), np.concatenate([[0], np.cumsum(c > 0)])
            cols = [pa.concat_arrays([h[k] for h in held]) for k in (2, 3)] + [pa.array(np.diff(first) + 1)]
            cols += [*(pa.array(x[first[1:]] - x[first[:-1]]) for x in (seen, weight)), pa.array(score)]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "weight", "score"])

        for b in batches:
            lists = [b.column(b.schema.get_field_index(c)) for c in ("doc_ids", "held_out")]
            for r, (chunk, kind, part, n, keys, numbers) in enumerate(_messages([b])):
                if at != chunk:
                    if held:
                        yield scored()
                    held, size = [], 0
                    at, chances, counts = chunk, Known(np.float32), Known(np.int64)
                if kind != ROW:
                    (chances if kind == GRAM else counts).put(n, keys, numbers)
                    continue
                held.append((plain(keys, part), unpacked(numbers, n, np.int64), *(x[r].values for x in lists)))
                size += part
                if size > SLICE_BYTES:
                    yield scored()
                    held, size = [], 0
        if held:
            yield scored()

    return run


def scores(docs: DataFrame, held_out: Column | None = None, order: int = ppm.ORDER, share: float = SHARE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score. held_out: a column; rows where it holds teach nothing. Nodes of the trie
    below `share` of the training bytes are pruned: by default none."""
    if held_out is None:
        held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    kind, local = docs.schema["doc_id"].dataType.simpleString(), min(LOCAL, order)
    shards = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES
    n = max(parts(docs.sparkSession), 2 * shards)
    all_ = written(docs.mapInArrow(_requests(order, local, shards, KEYS), _columns(kind)), "chunks")
    sent, rows = all_.where(F.col("kind") != ROW), all_.where(F.col("kind") == ROW)
    slim = sent.where(F.col("kind") != GRAM).repartition(n, "kind", "part").sortWithinPartitions("kind", "part")
    sums = written(slim.mapInArrow(_added, "kind int, kinds long, total long, keys binary, numbers binary"), "sums")
    of = {r.kind: r for r in sums.groupBy("kind").agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("total")).collect()}
    kinds, total, size = (of[WORD].kinds, of[WORD].total, of[LOW].total) if WORD in of else (0, 0, of[LOW].total if LOW in of else 0)
    ends = rows.agg(F.sum(F.size(F.filter("held_out", lambda x: ~x)))).first()[0] or 0
    tokens, kinds, least = total + ends, kinds + (ends > 0), max(1.0, share * size)
    # LOW_PARTS rows with at most 256 ** local numbers in all
    few = [(unpacked_keys(r.keys, r.kinds), unpacked(r.numbers, r.kinds, np.int64)) for r in sums.where((F.col("kind") == LOW) & (F.col("kinds") > 0)).collect()]
    key, count = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in few)]) for k in (0, 1))
    low = docs.sparkSession.sparkContext.broadcast(ppm.shares(key, count, least, local - 1))
    asked = sent.where(F.col("kind") != LOW).repartitionById(2 * shards, (F.col("kind") * shards + F.col("part")).cast("int")).sortWithinPartitions("kind", "part")
    both = asked.mapInArrow(_answers(low, order, local, least), _columns(kind)).unionByName(rows)
    # a task's first chunk bears its number; later ones go elsewhere
    place = F.pmod(F.col("chunk") + F.shiftright("chunk", 32) * 37, F.lit(n)).cast("int")
    dealt = both.repartitionById(n, place).sortWithinPartitions("chunk", "kind", "part")
    out = dealt.mapInArrow(_scores(order, local), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, weight double, score double")
    base = F.col("weight") + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(float(np.log10(tokens + kinds + 1)))
    known = F.col("n_known") + F.lit(int(ends > 0))
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
