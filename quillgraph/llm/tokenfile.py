"""Token-id output: one compressed file of a wavelet matrix per shard of documents.

Documents are dealt out by ranges of doc_id and sorted, so that shards in the order of
(part, shard) hold all documents in ascending doc_id order. A shard ends with the document
that fills it; its bytes are a row of a Parquet table (columns part, shard, before, tokens,
data), which any store that Spark writes to can hold and whose commit survives lost tasks.

    data: b"QGWM1", documents n (u32), n doc_ids (i64, null as -2**63), n lengths (u32,
          each with the end id), then the wavelet matrix of all ids (WaveletMatrix.dump)

Defined results: a null or empty text has just the end id; repeated rows are documents of
their own, one after the other; an empty table gives no file; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .store import parts, shared_folder
from .wavelet import WaveletMatrix
from .words import slices, text_column

MAGIC = b"QGWM1"
NULL = -(2**63)
SHARD_TOKENS = 1 << 20
SCHEMA = "part int, shard long, before long, tokens long, data binary"


class Shard:
    """Token access, counting and occurrence lookup over one shard."""

    def __init__(self, data: bytes) -> None:
        if data[:5] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack_from("<I", data, 5)
        self.doc_ids = np.frombuffer(data, "<i8", n, 9)
        self.lengths = np.frombuffer(data, "<u4", n, 9 + 8 * n).astype(np.int64)
        self.matrix, _ = WaveletMatrix.load(memoryview(data)[9 + 12 * n :])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    @staticmethod
    def dump(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
        return b"".join([MAGIC, struct.pack("<I", len(doc_ids)), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), WaveletMatrix.of(ids, bits).dump()])

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        ids = self.matrix.symbols()
        for d, a, b in zip(self.doc_ids.tolist(), self.starts[:-1], self.starts[1:]):
            yield d, ids[a:b]


def encoded(docs: DataFrame, n: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())


def token_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, doc_ids, lengths, ids) of small runs of documents."""
    for b in batches:
        data, off = text_column(b, "text")
        doc = b.column(b.schema.get_field_index("doc_id")).fill_null(NULL).to_numpy(zero_copy_only=False)
        for i, j in slices(off):
            ids, n = T.encoder(path).encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield b.column(b.schema.get_field_index("part"))[0].as_py(), doc[i:j], n, ids


def write(docs: DataFrame, folder: str, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the shards of docs (doc_id, text) as a table in the folder."""
    path = path or T.default_path()
    bits = max(1, int(max(T.encoder(path).tok.get_vocab().values())).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = before = shard = 0

        def row() -> pa.RecordBatch:
            data = Shard.dump(*(np.concatenate([h[k] for h in held]) for k in (1, 2, 3)), bits)
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int32()), pa.array([shard]), pa.array([before]), pa.array([size]), pa.array([data], pa.binary())], ["part", "shard", "before", "tokens", "data"])

        for part in token_batches(batches, path):
            held.append(part)
            size += len(part[3])
            if size >= shard_tokens:
                yield row()
                before, shard, held, size = before + size, shard + 1, [], 0
        if held:
            yield row()

    encoded(docs, parts(docs.sparkSession)).mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(folder)


def index(files: DataFrame) -> DataFrame:
    """Per document of files written by write(): doc_id, start, n_tokens, ids_crc32.

    Where each part begins follows from one number per part (so many rows as tasks wrote)."""
    per = files.groupBy("part").agg((F.max_by("before", "shard") + F.max_by("tokens", "shard")).alias("own"))
    from pyspark.sql import Window

    begins = per.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, before, data in zip(*(b.column(b.schema.get_field_index(c)) for c in ("begin", "before", "data"))):
                s = Shard(data.as_py())
                crc = [zlib.crc32(np.ascontiguousarray(ids, "<u4").data) for _, ids in s.documents()]
                doc = pa.array(s.doc_ids, pa.int64(), mask=s.doc_ids == NULL)
                yield pa.RecordBatch.from_arrays([doc, pa.array(s.starts[:-1] + begin.as_py() + before.as_py()), pa.array(s.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row per part, so bounded by the number of write tasks
    return files.join(F.broadcast(begins), "part").select("begin", "before", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None, folder: str | None = None) -> DataFrame:
    import uuid

    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, path)
    return index(spark.read.schema(SCHEMA).parquet(folder))
