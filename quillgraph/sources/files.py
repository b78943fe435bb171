"""Sources and sinks of JSON files. Schemas are given, never inferred: maps with data for keys
would become structs otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.ranges import numbered
from quillgraph.sources.blocks import blocks


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_lines(spark: SparkSession, path: str, schema: str, key: str | None = None, missing_ok: bool = False, tolerant: bool = False) -> DataFrame:
    """Records of JSON-lines files. key: of equal ones the last in file order stays (files by name).
    missing_ok: an absent path is an empty table. tolerant: broken lines are left out."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    d = spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)
    if key is None:
        return d
    place = F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    names = d.columns
    best = d.where(F.col(key).isNotNull()).select(*names, place.alias("_place")).groupBy(key).agg(F.max_by(F.struct(*names), "_place").alias("r"))
    return best.select(*[f"r.{n}" for n in names])


def json_documents(spark: SparkSession, path: str, schema: str, skip_prefix: str = "", start: int | None = None, stop: int | None = None) -> DataFrame:
    """One JSON document (or array) per file, in order of file names: files start..stop (inclusive,
    from 0) of those that do not begin with skip_prefix. The range is taken from the listing, before
    any file is read."""
    if skip_prefix or start is not None or stop is not None:
        names = [n for n in listed(spark, path) if not (skip_prefix and n.rsplit("/", 1)[-1].startswith(skip_prefix))]
        names = names[start or 0 : None if stop is None else stop + 1]
        if not names:
            return spark.createDataFrame([], schema).withColumn("file", F.lit(""))
        path = names
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def listed(spark: SparkSession, path: str) -> list[str]:
    """Files of a folder, or that a pattern names, in order of their names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p) or []
    each = [x for s in found for x in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    return sorted((x.getPath().toString() for x in each if x.isFile()), key=lambda n: n.rsplit("/", 1)[-1])


def release(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Samples of a release folder (its qa/*.jsonl) or of one JSON file with an object or an array."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return json_lines(spark, f"{path}/qa/*.jsonl", schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def chain_files(spark: SparkSession, folder: str, schema: str, depth: int | None = None, steps: int = 0) -> DataFrame:
    """Chains of all chains_d*.json in a folder, of one depth and with so many steps in their path."""
    d = json_documents(spark, f"{folder}/chains_d*.json", schema)
    if depth is not None:
        d = d.where(F.col("depth") == depth)
    return d.where(F.size("path") >= steps) if steps else d


def verdict_dirs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Verdicts of verdicts/<auditor>/*.json with the auditor from the path."""
    d = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/*.json")
    return d.withColumn("auditor", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def header_peek(spark: SparkSession, path: str, pattern: str, first: int = 500) -> DataFrame:
    """(file, value): a pattern's first group in the first bytes of each file; no more of it is read."""
    head = F.decode(F.col("head"), "UTF-8")
    return blocks(spark, listed(spark, path), first).select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), F.regexp_extract(head, pattern, 1).alias("value"))


def fingerprints(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """paths (name, path) with print: the first 16 hex digits of the file's SHA-256; empty without the file. Paths
    are listed by the driver, contents are digested block by block where they are read."""
    asked = {r.path: listed(spark, r.path) for r in paths.select("path").distinct().collect()}  # addresses only
    found = blocks(spark, sorted({f for fs in asked.values() for f in fs}))
    of = spark.createDataFrame([(p, f) for p, fs in asked.items() for f in fs[:1]], "path string, file string")
    print_ = of.join(found.select(F.col("path").alias("file"), F.substring("sha256", 1, 16).alias("print")), "file").select("path", "print")
    return paths.join(print_, "path", "left").withColumn("print", F.coalesce("print", F.lit("")))


def id_from_name(suffix: str = ".json", unsafe: str = "_", safe: str = "/") -> Column:
    """The id that a cache file's name stands for."""
    name = F.regexp_replace(F.col("_metadata.file_name"), F.lit(suffix.replace(".", r"\.") + "$"), F.lit(""))
    return F.replace(name, F.lit(unsafe), F.lit(safe))


def write_lines(df: DataFrame, path: str, dry_run: bool = False) -> None:
    """Overwrites JSON lines; a dry run only plans."""
    if dry_run:
        df.explain()
    else:
        df.write.mode("overwrite").json(path)


def write_combined(parts: list[DataFrame], path: str) -> None:
    """All parts as the lines of one table, missing fields left out."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    write_lines(every, path)


def write_failed(runs: DataFrame, path: str) -> None:
    """Attempts that ended with an error, beside the results."""
    write_lines(runs.where("terminated_by = 'error'"), path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one nested row as one JSON document."""
    report.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_per_key(df: DataFrame, path: str, key: str) -> None:
    """A folder for each key, its rows in one file."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def append_with_ids(old: DataFrame, new: DataFrame, id_column: str, prefix: str, order: list[Column | str]) -> DataFrame:
    """old and new, with ids for new that go on counting: prefix and four digits or more."""
    text = F.col("_id").cast("string")
    named = numbered(new, order, "_id", F.lit(old.count())).withColumn(id_column, F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(4), F.length(text)), F.lit("0")))).drop("_id")
    return old.unionByName(named, allowMissingColumns=True)


def request_lines(prompts: DataFrame, path: str, model: str, limit: int = 800_000) -> None:
    """Batch requests (custom_id, prompt) as JSON lines; prompts over the limit are left out."""
    body = F.struct(F.col("custom_id"), F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages")).alias("body"))
    prompts.where(F.length("prompt") <= limit).select(F.to_json(body).alias("value")).write.mode("overwrite").text(path)


def rewrite(spark: SparkSession, folder: str, schema: str, change: Callable[[DataFrame], DataFrame]) -> str:
    """Changes a versioned table: the newest folder v<n> is read, v<n+1> written; the old one stays."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(fs_path)]
    newest = max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))), default=0)
    change(spark.read.schema(schema).json(f"{folder}/v{newest}")).write.json(f"{folder}/v{newest + 1}")
    return f"{folder}/v{newest + 1}"
