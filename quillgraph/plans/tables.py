"""The driver's tables in the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Which tool each kind of event stands for.
TOOL_OF_EVENT = {"view": "get_paper_info", "click": "search_papers", "purchase": "read_section", "error": "think", "signup": "submit_answer"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels: question_type = lang, venue = source, is_correct = quality 1 (null: unknown)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    one = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return d.join(one, "doc_id", "left").withColumn("is_correct", F.coalesce(F.col("quality") == 1, F.lit(False)))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tool calls: sample, ts, event_id, tool, paper, tokens."""
    names = F.create_map(*(F.lit(x) for kv in TOOL_OF_EVENT.items() for x in kv))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample"), "ts", "event_id", F.coalesce(F.element_at(names, F.col("event_type")), F.lit("other")).alias("tool"),
        F.get_json_object("props", "$.k").cast("int").alias("paper"), F.col("value").alias("tokens"),
    )


def tasks(rows: DataFrame, each: int = 250_000) -> int:
    """How many tasks a table's rows are dealt to by key, so that a task's share does not grow with the table."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def edges(spark: SparkSession, sf_dir: str, which: str = "SP") -> DataFrame:
    """Suppliers cite the parts of their lines (S) and parts their suppliers (P); pos in order of the target."""
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    n, out = tasks(d), None
    s, p = F.concat(F.lit("S"), F.col("l_suppkey")), F.concat(F.lit("P"), F.col("l_partkey"))
    w = Window.partitionBy("src").orderBy("dst")
    for kind, src, dst in (("S", s, p), ("P", p, s)):
        if kind in which:
            # equal targets of a source follow each other, so one sort gives places and leaves out copies
            e = d.select(src.alias("src"), dst.alias("dst")).repartition(n, "src")
            e = e.select("src", "dst", F.dense_rank().over(w).alias("pos"), F.row_number().over(w).alias("at"), F.lag("dst").over(w).alias("before"))
            e = e.where(~F.col("dst").eqNullSafe(F.col("before")) | (F.col("at") == 1)).select("src", "dst", "pos")
            out = e if out is None else out.unionByName(e)
    return out


EDGES_SQL = """d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
e0 AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst FROM d UNION ALL SELECT 'P' || l_partkey, 'S' || l_suppkey FROM d),
edges AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos FROM e0)"""

QA_SQL = """l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
qa AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, coalesce(l.quality = 1, false) AS is_correct FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id)"""

CALLS_SQL = "calls AS (SELECT user_id AS sample, ts, event_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TOOL_OF_EVENT.items()) + " ELSE 'other' END AS tool, CAST(json_extract_string(props, '$.k') AS INT) AS paper, value AS tokens FROM events)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: their lines are sections; the header is the first three words of a line."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "body"))
    return d.withColumn("header", F.array_join(F.slice(F.regexp_extract_all("body", F.lit(r"[^\s]+"), 0), 1, 3), " "))


LINES_SQL = r"""s0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
lines AS (SELECT doc_id, pos, body, array_to_string(regexp_extract_all(body, '[^\s]+')[1:3], ' ') AS header FROM s0)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order vote with their flag for the order's status."""
    t = F.create_map(F.lit("F"), F.lit("A"), F.lit("O"), F.lit("N"), F.lit("P"), F.lit("R"))
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("provider"), F.col("l_returnflag").alias("answer"), F.col("l_partkey").alias("paper"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), F.element_at(t, F.col("o_orderstatus")).alias("truth"))
    n = tasks(v)
    return v.repartition(n, "qid").join(o.repartition(n, "qid"), "qid")


VOTES_SQL = """votes AS (SELECT l_orderkey AS qid, l_linenumber AS provider, l_returnflag AS answer, l_partkey AS paper,
CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' WHEN 'P' THEN 'R' END AS truth FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as finished trajectories with what is known of their samples."""
    pick = lambda *xs: F.array(*map(F.lit, xs))
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c", "o_orderstatus", "o_orderpriority").select(
        F.concat(F.lit("s"), "k").alias("sample_id"), F.when(F.col("c") % 2 == 0, "single-target").otherwise("multi-target").alias("question_type"), (F.col("k") % 2 + 1).cast("int").alias("depth"),
        F.element_at(pick("METHOD", "RESULT", "MOTIVE", "GROUND"), (F.col("c") % 4 + 1).cast("int")).alias("reasoning_type"), F.col("o_orderpriority").alias("venue"), F.when(F.col("c") % 5 != 0, "gold").alias("tier"),
        (F.col("c") % 3).alias("filter_agreement"), F.when(F.col("k") % 3 != 0, F.col("k") % 3 == 1).alias("bridge_necessary"), (F.col("o_orderstatus") == "F").alias("is_correct"),
        F.when(F.col("c") % 7 == 0, "error").when(F.col("c") % 7 == 1, "budget").otherwise("answer").alias("terminated_by"), (F.col("k") % 6 - 1).cast("int").alias("predicted_index"), (F.col("c") % 4).cast("int").alias("correct_index"),
        pick("seed_only", "correct", "wrong_paper", "no_context").alias("distractor_types"), (F.col("c") % 20 + 1).alias("total_turns"), (F.col("c") * 10).alias("total_prompt_tokens"), (F.col("c") % 100).alias("total_completion_tokens"),
        (F.col("k") % 50 * 100).alias("cache_read_tokens"), (F.col("k") % 10).alias("cache_creation_tokens"), (F.col("k") % 1000 / 8).alias("wall_time_s"), (F.col("k") % 31).alias("budget_used"),
        (F.col("k") % 11 == 0).cast("int").alias("api_error_count"), (F.col("c") % 13).alias("transient_retry_count"), (F.col("c") % 3).alias("tool_errors"), (F.col("k") % 4).alias("retry_count"),
    )


RUNS_SQL = """runs AS (SELECT 's' || o_orderkey AS sample_id, CASE WHEN o_custkey % 2 = 0 THEN 'single-target' ELSE 'multi-target' END AS question_type, o_orderkey % 2 + 1 AS depth,
['METHOD', 'RESULT', 'MOTIVE', 'GROUND'][o_custkey % 4 + 1] AS reasoning_type, o_orderpriority AS venue, CASE WHEN o_custkey % 5 <> 0 THEN 'gold' END AS tier, o_custkey % 3 AS filter_agreement,
CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 3 = 1 END AS bridge_necessary, o_orderstatus = 'F' AS ok, CASE o_custkey % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'budget' ELSE 'answer' END AS terminated_by,
o_orderkey % 6 - 1 AS predicted_index, o_custkey % 4 AS correct_index, o_custkey % 20 + 1 AS total_turns, o_custkey * 10 AS prompt, o_custkey % 100 AS completion, o_orderkey % 50 * 100 AS cread, o_orderkey % 10 AS ccreate,
o_orderkey % 1000 / 8 AS wall, o_orderkey % 31 AS budget, (o_orderkey % 11 = 0)::INT AS api, o_custkey % 13 AS transient, o_custkey % 3 AS terr, o_orderkey % 4 AS retry_count FROM orders)"""
