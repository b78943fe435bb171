"""Line deduplication: lines found in many documents stay in the last of them only.

Documents are hashed in chunks: for each chunk one row with the 128-bit hashes of the keys of its
lines (stripped, in lower case, long enough). Each chunk counts its own documents for each hash before
these counts are added up. The hashes held by two documents or more, a lone line being dropped by none,
are dealt to shards; each shard is a minimal perfect hash with three arrays: a fingerprint (64 bits of
the hash that the place does not tell), the number of documents, and the largest doc_id. Chunks
probe the shards with their distinct hashes, packed in one message for a chunk and a shard, and get
back the hashes found in enough documents. So a line of a third of all documents is one probe of a
chunk, no line is a row of a join, and a task holds one shard and one message at a time. Then each
chunk says which lines of which documents go. Exact but for collisions: of 128-bit hashes of lines,
and of 64 bits at the same place for lines that one document holds.

Defined results: a null or empty text is one empty line; rows are documents of their own, also where
ids repeat or are missing; all rows with the largest id keep the line; a missing id is below all others,
and if all rows with the line lack an id, all keep it; rows with equal id and text have equal results;
an empty table gives an empty result; texts of any length are whole; other columns come back unchanged
where texts are asked for, unless one has the name of a result column, and are not read otherwise.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.packed import MEET, meet, meet_batch, pack, unpacked

from .mixing import spare_names
from .perfecthash import PerfectHash
from .store import small_batches, written

SPACE = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 15
NO_ID = -(2**63)


def _chunks(shortest: int):
    """Rows (doc_id, text) to one row a batch: of each long line the hash, its document and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, hashes, places, size = [], [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py().encode()
                n = len(hashes)
                for i, line in enumerate(text.split(b"\n")):
                    if len(line) >= shortest:
                        key = line.strip(SPACE)
                        if len(key) >= shortest and (key.isascii() or len(key.decode()) >= shortest):
                            hashes.append(hashlib.blake2b(key.lower(), digest_size=16).digest())
                            places.append(i)
                if len(hashes) > n:
                    ids.append(d)
                    texts.append(hashlib.md5(text).digest())
                    size.append(len(hashes) - n)
            if ids:
                h = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
                data = pack(hi=h[:, 0], lo=h[:, 1], place=np.array(places, np.int32), size=np.array(size, np.int32), id=np.array(ids, np.int64), text=np.frombuffer(b"".join(texts), np.uint8))
                yield meet_batch([(uuid.uuid4().int >> 65, 2, 0, data)])

    return run


def _distinct(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, documents, largest id) of the distinct hashes of a chunk."""
    doc = np.repeat(np.arange(len(c["size"])), c["size"])
    order = np.lexsort((doc, c["lo"], c["hi"]))
    hi, lo, doc = c["hi"][order], c["lo"][order], doc[order]
    new = np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
    first = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    return hi[first], lo[first], np.add.reduceat(other.astype(np.int64), first), np.maximum.reduceat(c["id"][doc], first)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, c in unpacked(batches):
        hi, lo, n, last = _distinct(c)
        yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(n), pa.array(last)], ["hi", "lo", "n", "last"])


def _index(t: pa.Table) -> pa.Table:
    """A shard: its perfect hash, and the arrays in the order of its numbers."""
    hi, lo, n, last = (t.column(c).to_numpy() for c in ("hi", "lo", "n", "last"))
    hi, lo = hi.view(np.uint64), lo.view(np.uint64)
    h = PerfectHash.of(hi, lo)
    order = np.empty(len(hi), np.int64)
    order[h.numbers(hi, lo)] = np.arange(len(hi))
    n = n.astype(np.min_scalar_type(n.max()))
    return pa.Table.from_batches([meet_batch([(t.column("shard")[0].as_py(), 0, 0, pack(bits=h.bits, sizes=h.sizes, print=hi[order], n=n[order], last=last[order]))])])


def _ask(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, _, c in unpacked(batches):
            hi, lo, _, _ = _distinct(c)
            shard = shard_of(hi, shards)
            order = np.argsort(shard, kind="stable")
            hi, lo, shard = hi[order], lo[order], shard[order]
            cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist()
            yield meet_batch([(int(shard[a]), 1, chunk, pack(hi=hi[a:z], lo=lo[a:z])) for a, z in zip(cut, [*cut[1:], len(hi)])])

    return run


def shard_of(hi: np.ndarray, shards: int) -> np.ndarray:
    """As pmod of the signed value."""
    return np.mod(hi.view(np.int64), shards)


def _probe(least: int):
    def run(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        here, h, shard = None, None, {}
        for key, kind, chunk, x in rows:
            if kind == 0:
                here, h, shard = key, PerfectHash(x["bits"], x["sizes"]), x
            elif here == key:
                at = h.numbers(x["hi"], x["lo"])
                found = (at >= 0) & (shard["print"][at] == x["hi"]) & (shard["n"][at] >= least)
                if found.any():
                    yield meet_batch([(chunk, 1, key, pack(hi=x["hi"][found], lo=x["lo"][found], last=shard["last"][at[found]]))])

    return run


def _dropped(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Per document with lines to drop, the places of these. A chunk's replies come before the chunk."""
    last: dict[tuple[int, int], int] = {}
    here = None
    for key, kind, _, x in rows:
        if key != here:
            last, here = {}, key
        if kind == 1:
            last.update(zip(zip(x["hi"].tolist(), x["lo"].tolist()), x["last"].tolist()))
        elif last:
            out: list[tuple[int, str, list[int]]] = []
            hi, lo, place, edge = x["hi"].tolist(), x["lo"].tolist(), x["place"].tolist(), np.concatenate([[0], np.cumsum(x["size"])]).tolist()
            for d, (i, a, z) in enumerate(zip(x["id"].tolist(), edge, edge[1:])):
                gone = [place[k] for k in range(a, z) if last.get((hi[k], lo[k]), NO_ID) > i]
                if gone:
                    out.append((i, x["text"][16 * d : 16 * d + 16].tobytes().hex(), gone))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.list_(pa.int32()))], ["i", "m", "gone"])


def dropped_lines(docs: DataFrame, least: int = 5, shortest: int = 40) -> DataFrame:
    """(i, m, gone): of rows of docs (doc_id, text) the id (NO_ID for none), the md5 of the text and the
    places, from 0, of the lines that go; rows that keep all lines are absent."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(_id(), "text").where(F.length("text") >= shortest)
    chunks = written(slim.mapInArrow(_chunks(shortest), MEET), "chunks")
    counts = chunks.mapInArrow(_counts, "hi long, lo long, n long, last long").groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    known = written(counts.where("n > 1"), "lines")
    shards = max(1, -(-known.count() // SHARD_KEYS))
    index = known.withColumn("shard", F.pmod("hi", F.lit(shards))).groupBy("shard").applyInArrow(_index, MEET)
    replies = meet(index.unionByName(chunks.mapInArrow(_ask(shards), MEET)), _probe(least), MEET)
    return meet(replies.unionByName(chunks), _dropped, "i long, m string, gone array<int>")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("i")


def deduplicated(docs: DataFrame, least: int = 5, shortest: int = 40, texts: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) with n_lines, n_dropped, kept_sha256 and, unless texts is false, kept (the
    lines that stay, joined by newlines). Without texts, only doc_id stays of docs."""
    added = ["n_lines", "n_dropped", "kept_sha256", "kept"][: 4 if texts else 3]
    keep = [c for c in docs.columns if c.lower() not in added] if texts else ["doc_id"]
    kinds, spare = dict(docs.dtypes), spare_names(docs)
    i, m, gone = (spare(c) for c in ("i", "m", "gone"))
    gones = dropped_lines(docs, least, shortest).dropDuplicates(["i", "m"]).withColumnsRenamed({"i": i, "m": m, "gone": gone})
    gones = written(gones, "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in added]
            for t, g in zip(b.column(b.schema.get_field_index("text")), b.column(b.schema.get_field_index(gone))):
                text = (t.as_py() or "").encode()
                n = text.count(b"\n") + 1
                if g.is_valid:
                    stays = np.ones(n, bool)
                    stays[g.values.to_numpy()] = False
                    text = b"\n".join(compress(text.split(b"\n"), stays.tolist()))
                for x, y in zip(out, (n, len(g.values) if g.is_valid else 0, hashlib.sha256(text).hexdigest(), text.decode() if texts else "")):
                    x.append(y)
            cols = [b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, keep + added)

    wanted = list(dict.fromkeys([*keep, "text"]))
    of = docs.select(*(F.col(f"`{c}`") for c in wanted), _id().alias(i), F.md5("text").alias(m))
    full = of.join(gones, [i, m], "left").select(*(F.col(f"`{c}`") for c in wanted), gone)
    return full.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_lines long", "n_dropped long", "kept_sha256 string", "kept string"][: len(added)]))


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""
