"""Files by byte ranges: their first bytes, and digests in blocks, as a Python data source.

Executors open the files themselves, by the address Spark lists them under, so only the bytes that are asked
for travel. An address that only Spark can open (its scheme is not in OPENS) is read as whole
binary files instead, with the same result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 1 << 20  # bytes that are held at a time
FILES = 64  # of a partition at most
OPENS = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def opened(uri: str):
    """A file for reading at any place."""
    from pyarrow.fs import FileSystem

    scheme, colon, rest = uri.partition(":")
    at = f"s3:{rest}" if scheme == "s3a" else f"file://{rest}" if colon and scheme == "file" and not rest.startswith("//") else uri
    fs, path = FileSystem.from_uri(at)
    return fs.open_input_file(path)


class BlockReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files, self.first = json.loads(options["files"]), int(options.get("first", 0))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.files[i : i + FILES]) for i in range(0, len(self.files), FILES)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for uri in partition.value:
            with opened(uri) as f:
                if self.first:
                    yield uri, f.size(), f.read_at(min(self.first, f.size()), 0), None
                    continue
                digest = hashlib.sha256()
                while block := f.read(BLOCK):
                    digest.update(block)
                yield uri, f.size(), None, digest.hexdigest()


class Blocks(DataSource):
    """Options: files, a JSON array of addresses; first, the bytes that are wanted of each, or none for digests."""

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return "path string, size long, head binary, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(self.options)


def blocks(spark: SparkSession, files: list[str], first: int = 0) -> DataFrame:
    """(path, size, head, sha256) of the files: the first bytes, or, where `first` is 0, the digest."""
    if not files:
        return spark.createDataFrame([], "path string, size long, head binary, sha256 string")
    if all(f.partition(":")[0] in OPENS for f in files):
        spark.dataSource.register(Blocks)
        return spark.read.format("blocks").option("files", json.dumps(files)).option("first", str(first)).load()
    whole = spark.read.format("binaryFile").load(files).select("path", "length", "content")
    every = spark.createDataFrame([(f,) for f in files], "path string").join(whole, "path", "left")  # Spark leaves out empty files
    content = F.coalesce("content", F.lit(b""))
    head = F.substring(content, 1, first) if first else F.lit(None).cast("binary")
    return every.select("path", F.coalesce("length", F.lit(0)).cast("long").alias("size"), head.alias("head"), (F.lit(None).cast("string") if first else F.sha2(content, 256)).alias("sha256"))
