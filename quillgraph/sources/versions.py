"""Versions of a table in a folder, as a Python data source that commits.

Each task writes files of its own under a name that nobody reads; when all tasks have ended, the driver
writes the list of their files, and then swaps one small pointer file, so that a reader sees the old version or
the new one and never a part. If a task fails for good, what the others wrote goes, and the pointer
stays. Repeated tasks write other names, and only those that committed are listed. With a key, each
of its values has a file of its own, named by it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

POINTER = "CURRENT"


def folder_of(uri: str):
    """(file system, path) of a folder, for driver and executors alike."""
    from pyarrow.fs import FileSystem

    scheme, colon, rest = uri.partition(":")
    return FileSystem.from_uri(f"file://{rest}" if colon and scheme == "file" and not rest.startswith("//") else uri)


def file_name(key: str) -> str:
    """A key as a name that readers do not take for hidden; the empty key (and null) is %00."""
    name = quote(key, safe="") or "%00"
    return f"%{ord(name[0]):02X}{name[1:]}" if name[0] in "._" else name


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class VersionWriter(DataSourceWriter):
    def __init__(self, folder: str, keyed: bool) -> None:
        self.folder, self.keyed, self.version = folder, keyed, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        fs, path = folder_of(self.folder)
        own, files, n, out, last = f"{path}/{self.version}/{uuid.uuid4().hex}", [], 0, None, object()
        fs.create_dir(own, recursive=True)
        try:
            for r in rows:
                if out is None or (self.keyed and r[0] != last):
                    if out is not None:
                        out.close()
                    last = r[0]
                    name = f"{file_name(r[0])}.json" if self.keyed else "part.json"
                    out = fs.open_output_stream(f"{own}/{name}")
                    files.append(f"{own.rpartition('/')[2]}/{name}")
                out.write(r[1].encode() + b"\n")
                n += 1
        finally:
            if out is not None:
                out.close()
        return Written(files, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = folder_of(self.folder)
        done = [m for m in messages if m is not None]
        listed = {"version": self.version, "files": sorted(f for m in done for f in m.files), "rows": sum(m.rows for m in done)}
        fs.create_dir(f"{path}/{self.version}", recursive=True)
        self._put(fs, f"{path}/{self.version}/FILES", json.dumps(listed))
        self._put(fs, f"{path}/{POINTER}", self.version)

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = folder_of(self.folder)
        if fs.get_file_info(f"{path}/{self.version}").type.name != "NotFound":
            fs.delete_dir(f"{path}/{self.version}")

    @staticmethod
    def _put(fs, path: str, text: str) -> None:
        part = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(text.encode())
        fs.move(part, path)  # whole or not there


class Versions(DataSource):
    """Options: folder; keyed, if the first column names the file. Columns: key string, line string."""

    @classmethod
    def name(cls) -> str:
        return "versions"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return VersionWriter(self.options["folder"], self.options.get("keyed") == "true")


def save(df: DataFrame, folder: str, key: str | None = None) -> str:
    """A new version of the table in the folder, which becomes the current one at the end; its name. With a key, rows
    of a value go to one file named by it; else each task writes one file."""
    spark = df.sparkSession
    spark.dataSource.register(Versions)
    k = F.col(key).cast("string") if key else F.lit("")
    rows = df.select(F.coalesce(k, F.lit("")).alias("key"), F.to_json(F.struct(*df.columns)).alias("line"))
    rows = rows.repartition("key").sortWithinPartitions("key") if key else rows
    rows.write.format("versions").option("folder", folder).option("keyed", str(bool(key)).lower()).mode("append").save()
    return current(folder)


def current(folder: str) -> str | None:
    """The version a reader gets, None before the first."""
    fs, path = folder_of(folder)
    try:
        with fs.open_input_stream(f"{path}/{POINTER}") as f:
            return f.read().decode()
    except FileNotFoundError:
        return None


def listed(folder: str, version: str | None = None) -> list[str]:
    """The files of a version (the current one)."""
    fs, path = folder_of(folder)
    version = version or current(folder)
    if version is None:
        return []
    with fs.open_input_stream(f"{path}/{version}/FILES") as f:
        return [f"{folder}/{version}/{x}" for x in json.loads(f.read())["files"]]


def load(spark: SparkSession, folder: str, schema: str, version: str | None = None) -> DataFrame:
    """The rows of a version (the current one), or none before the first."""
    files = listed(folder, version)
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
