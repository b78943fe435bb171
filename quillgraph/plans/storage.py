"""Queries that write files and read them back, with what must come back in DuckDB SQL. The files
lie in the shared folder and go when the driver ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import evaluation
from quillgraph.plans import reviews, runner
from quillgraph.plans import tables as T
from quillgraph.session import shared_folder
from quillgraph.sources import files, versions


def _folder(spark: SparkSession, what: str) -> str:
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def _one_each(df: DataFrame, path: str, *order: str) -> None:
    """A file per row of a small table; their names are in the order of the rows."""
    df.coalesce(1).sortWithinPartitions(*order).write.option("maxRecordsPerFile", 1).json(path)


def pool_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as records of their parts: the last record of a part counts; a pool that is not there is empty."""
    at, kind = _folder(spark, "pool"), "paper long, o long, l int"
    d = T.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("paper"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"))
    files.write_lines(d.repartitionByRange("o", "l").sortWithinPartitions("o", "l"), at)
    files.write_lines(d, f"{at}/none", dry_run=True)
    return files.json_lines(spark, at, kind, key="paper").unionByName(files.json_lines(spark, f"{at}/none", kind, missing_ok=True))


POOL_SQL = "SELECT l_partkey AS paper, l_orderkey AS o, l_linenumber AS l FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1"


def tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth line breaks off."""
    at, id_ = _folder(spark, "broken"), F.col("o_orderkey").cast("string")
    line = F.concat(F.lit('{"id": '), id_, F.lit(', "status": "'), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise('"}'))
    T.table(spark, sf_dir, "orders").select(line.alias("value")).write.text(at)
    return files.json_lines(spark, at, "id long, status string", tolerant=True)


def per_key_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in a file for each nation, named by it."""
    at = _folder(spark, "nations")
    versions.save(T.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name"), at, "c_nationkey")
    d = spark.read.schema("c_custkey long, c_name string").json(versions.listed(at))
    return d.withColumn("c_nationkey", F.regexp_extract("_metadata.file_name", r"^(\d+)\.json$", 1).cast("int"))


def file_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first nation in each region's file, from the file's head."""
    at = _folder(spark, "heads")
    d = T.table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")
    d.repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey").write.partitionBy("n_regionkey").json(at)
    return files.header_peek(spark, f"{at}/*/*.json", r'"n_nationkey":(\d+)').select(F.col("value").cast("int").alias("first"))


def file_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per nation, of which the fourth to the tenth are asked for, and those of every file."""
    at = _folder(spark, "range")
    _one_each(T.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), at, "n_nationkey")
    some = files.json_documents(spark, at, "n_nationkey int, n_name string", skip_prefix="_", start=3, stop=9)
    every = files.json_documents(spark, at, "n_nationkey int, n_name string", skip_prefix="_")
    return some.select(F.lit("some").alias("part"), "n_nationkey", "n_name").unionByName(every.select(F.lit("every").alias("part"), "n_nationkey", "n_name"))


RANGE_SQL = """SELECT 'some' AS part, n_nationkey, n_name FROM nation QUALIFY row_number() OVER (ORDER BY n_nationkey) BETWEEN 4 AND 10
UNION ALL SELECT 'every', n_nationkey, n_name FROM nation"""


def file_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of the regions' file, and of one that is not there."""
    at = _folder(spark, "print")
    T.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("value")).coalesce(1).sortWithinPartitions("value").write.text(at)
    name = next(n for n in files.listed(spark, at) if n.endswith(".txt"))
    paths = spark.createDataFrame([("regions", name), ("none", f"{at}/none")], "file string, path string")
    return files.fingerprints(spark, paths).select("file", "print")


PRINTS_SQL = "SELECT 'regions' AS file, substr(sha256(string_agg(r_regionkey::VARCHAR || chr(10), '' ORDER BY r_regionkey::VARCHAR)), 1, 16) AS print FROM region UNION ALL SELECT 'none', ''"


def release_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a release folder, regions as one file with an array."""
    at = _folder(spark, "release")
    T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).write.json(f"{at}/folder/qa/full.jsonl")
    few = F.to_json(F.collect_list(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))))  # five rows
    T.table(spark, sf_dir, "region").agg(few.alias("value")).write.text(f"{at}/array")
    one = next(n for n in files.listed(spark, f"{at}/array") if n.endswith(".txt"))
    kind = "id long, name string"
    return files.release(spark, f"{at}/folder", kind).unionByName(files.release(spark, one, kind))


def chain_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as chains of one step, nations as chains of two; asked for by depth and steps."""
    at, kind = _folder(spark, "chains"), "depth int, path array<string>"
    r, n = T.table(spark, sf_dir, "region"), T.table(spark, sf_dir, "nation")
    _one_each(r.select(F.lit(1).alias("depth"), F.array("r_name").alias("path")), f"{at}/chains_d1.json", "path")
    both = n.join(r, n.n_regionkey == r.r_regionkey).select(F.lit(2).alias("depth"), F.array("r_name", "n_name").alias("path"))
    _one_each(both, f"{at}/chains_d2.json", "path")
    asked = [("all", None, 0), ("two", 2, 2), ("none", 1, 2)]
    parts = [files.chain_files(spark, at, kind, depth, steps).select(F.lit(name).alias("asked"), "depth", F.array_join("path", ">").alias("path")) for name, depth, steps in asked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


CHAINS_SQL = """WITH d AS (SELECT 1 AS depth, r_name AS path FROM region UNION ALL SELECT 2, r_name || '>' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'all' AS asked, depth, path FROM d UNION ALL SELECT 'two', depth, path FROM d WHERE depth = 2"""


def verdict_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of two auditors in folders of their own."""
    at = _folder(spark, "verdicts")
    n = T.table(spark, sf_dir, "nation").select(F.concat(F.lit("vf_"), "n_name", F.lit("_c"), F.col("n_nationkey").cast("string")).alias("case_id"), "n_nationkey")
    for k, who in enumerate(("ann", "bo")):
        _one_each(n.where(F.col("n_nationkey") % 2 == k).select("case_id"), f"{at}/{who}", "case_id")
    return files.verdict_dirs(spark, at, "case_id string")


def combined_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers as one table, and beside it the orders that ended with an error."""
    at, kind = _folder(spark, "combined"), "id long, balance double, terminated_by string"
    end = F.when(F.col("o_orderkey") % 7 == 0, "error").otherwise("submit")
    a = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), end.alias("terminated_by"))
    b = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("balance"))
    files.write_combined([a, b], f"{at}/all")
    files.write_failed(a, f"{at}/failed")
    read = lambda what: files.json_lines(spark, f"{at}/{what}", kind).withColumn("file", F.lit(what))
    return read("all").unionByName(read("failed"))


COMBINED_SQL = """WITH a AS (SELECT o_orderkey AS id, NULL::DOUBLE AS balance, CASE WHEN o_orderkey % 7 = 0 THEN 'error' ELSE 'submit' END AS terminated_by FROM orders)
SELECT *, 'all' AS file FROM a UNION ALL SELECT c_custkey, c_acctbal::DOUBLE, NULL, 'all' FROM customer UNION ALL SELECT *, 'failed' FROM a WHERE terminated_by = 'error'"""


def request_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per order; prompts of over 40 characters are left out."""
    at = _folder(spark, "requests")
    k = F.col("o_orderkey")
    d = T.table(spark, sf_dir, "orders").select(F.concat(F.lit("q_"), k.cast("string")).alias("custom_id"), F.repeat(F.lit("word "), (k % 12).cast("int")).alias("prompt"))
    files.request_lines(d, at, "m", limit=40)
    body = "body struct<model: string, messages: array<struct<role: string, content: string>>>"
    got = files.json_lines(spark, at, f"custom_id string, {body}")
    return got.select("custom_id", "body.model", F.col("body.messages")[0]["role"].alias("role"), F.col("body.messages")[0]["content"].alias("content"))


REQUESTS_SQL = "SELECT 'q_' || o_orderkey AS custom_id, 'm' AS model, 'user' AS role, repeat('word ', (o_orderkey % 12)::INT) AS content FROM orders WHERE o_orderkey % 12 <= 8"


def rewritten_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table rewritten twice; every version stays readable."""
    at, kind = _folder(spark, "versions"), "c_custkey long, c_nationkey int"
    names = [versions.save(T.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), at)]
    names.append(versions.save(versions.load(spark, at, kind).where("c_custkey % 2 = 0"), at))
    names.append(versions.save(versions.load(spark, at, kind).withColumn("c_nationkey", F.col("c_nationkey") + 100), at))
    parts = [versions.load(spark, at, kind, n).withColumn("version", F.lit(v)) for v, n in enumerate(names, 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


VERSIONS_SQL = """SELECT c_custkey, c_nationkey, 1 AS version FROM customer UNION ALL SELECT c_custkey, c_nationkey, 2 FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, c_nationkey + 100, 3 FROM customer WHERE c_custkey % 2 = 0"""


def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested report as a JSON document, read back and shown as its figures."""
    at = _folder(spark, "report")
    one = evaluation.evaluation(T.runs(spark, sf_dir), {"model": "m"})
    files.write_report(one, at)
    d = spark.read.schema(one.schema).json(at).select(F.explode("sections").alias("section", "figures")).select("section", F.explode("figures").alias("key", "f"))
    return d.select("section", "key", "f.n", "f.correct", F.round("f.value", 4).alias("value"))


def staged_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stages: a run up to the second, then a run from the third, which reads what the first left."""
    at = _folder(spark, "stages")
    stages: list[runner.Stage] = [
        ("spent", lambda s, t: T.table(s, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))),
        ("many", lambda s, t: t["spent"].where("n >= 3")),
        ("named", lambda s, t: t["many"].join(T.table(s, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "n")),
    ]
    runner.run(spark, stages, at, last="many")
    runner.run(spark, stages, at, first="named")
    return spark.read.parquet(f"{at}/named")


STAGES_SQL = "SELECT c_custkey, c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) >= 3"

QUERIES = {
    "pool_scan": (pool_scan, POOL_SQL),
    "tolerant_scan": (tolerant_scan, "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 <> 0"),
    "per_key_files": (per_key_files, "SELECT c_custkey, c_nationkey, c_name FROM customer"),
    "file_heads": (file_heads, "SELECT min(n_nationkey) AS first FROM nation GROUP BY n_regionkey"),
    "file_range": (file_range, RANGE_SQL),
    "file_prints": (file_prints, PRINTS_SQL),
    "release_forms": (release_forms, "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT r_regionkey, r_name FROM region"),
    "chain_scan": (chain_scan, CHAINS_SQL),
    "verdict_files": (verdict_files, "SELECT 'vf_' || n_name || '_c' || n_nationkey AS case_id, CASE n_nationkey % 2 WHEN 0 THEN 'ann' ELSE 'bo' END AS auditor FROM nation"),
    "combined_files": (combined_files, COMBINED_SQL),
    "request_files": (request_files, REQUESTS_SQL),
    "rewritten_files": (rewritten_files, VERSIONS_SQL),
    "report_file": (report_file, reviews.REPORT_SQL),
    "staged_run": (staged_run, STAGES_SQL),
}
