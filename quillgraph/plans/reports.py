"""Queries of the evaluation report, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import numbers
from quillgraph.operators import ranges, replay, report
from quillgraph.plans import tables as T

_RATE = "coalesce(round(({0})::DOUBLE / nullif({1}, 0), 4), 0)"
_ACC = f"count(*) AS n, count_if(is_correct) AS correct, {_RATE.format('count_if(is_correct)', 'count(*)')} AS accuracy"


def bucket_accuracy_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.bucket_accuracy(T.qa(spark, sf_dir), [["lang"], ["source"], ["lang", "source"], []]).select("lang", "source", "n", "correct", "accuracy")


def accuracy_by_source_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.qa(spark, sf_dir)
    known = F.count("quality")
    return d.groupBy("source").agg(F.count("*").alias("n"), known.alias("labelled"), numbers.rate(F.count_if("is_correct"), known).alias("accuracy"))


def accuracy_by_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.qa(spark, sf_dir).withColumns({"question_type": F.when(F.col("lang") == "en", "multi-target").otherwise("single-target"), "depth": (F.col("doc_id") % 2 + 1).cast("int"), "bridge_necessary": F.col("toxic") == 1})
    return report.by_bridge(d)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select("doc_id", ((F.col("doc_id") * 7 + F.col("n_chars")) % 6 - 1).cast("int").alias("predicted_index"), (F.col("n_chars") % 4).cast("int").alias("correct_index"))
    kinds = F.array(*(F.lit(x) for x in ("seed_only", "wrong_paper", "no_context")))
    right = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == F.col("correct_index"), F.lit("correct")).otherwise(F.get(kinds, (i + F.col("doc_id")).cast("int") % 3)))
    return d.withColumn("is_correct", F.col("predicted_index") == F.col("correct_index")).withColumn("distractor_types", F.when(F.col("doc_id") % 11 != 0, right))


_PRED = """p AS (SELECT doc_id, (doc_id * 7 + n_chars) % 6 - 1 AS pred, n_chars % 4 AS cor FROM documents),
q AS (SELECT *, pred = cor AS ok FROM p)"""


def position_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.position_bias(_predictions(spark, sf_dir))


def failure_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.failure_attribution(_predictions(spark, sf_dir))


def tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.calls(spark, sf_dir)
    return report.tool_usage(d.select("sample", "tool", replay.tool_cost(F.col("tool")).alias("cost"), (F.col("tokens") > 20).alias("rejected")))


def turn_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.calls(spark, sf_dir).select("sample", F.struct("ts", "event_id").alias("ord"), F.round(F.col("tokens") * 100).cast("long").alias("cents"))
    return report.turn_profile(d, "cents").select("k", "n", "mean")


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what labels know of them as samples with all fields, missing ones by their defaults."""
    d = T.qa(spark, sf_dir)
    rows = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("question_type"), F.col("quality").alias("depth"), F.col("source").alias("venue"), F.when(F.col("toxic") == 1, F.array("lang", "source")).alias("options"), F.col("toxic").alias("filter_agreement"), "n_chars")
    s = report.samples(rows)
    return s.withColumns({c: F.array_join(c, ",") for c, k in s.dtypes if k.startswith("array")})


SAMPLES_SQL = f"""WITH {T.QA_SQL} SELECT coalesce(doc_id::VARCHAR, '') AS id, coalesce(lang, '') AS question_type, coalesce(quality, 0) AS depth, '' AS reasoning_type, '' AS cognitive_skill, coalesce(source, '') AS venue, '' AS consensus_tier,
  '' AS question, CASE WHEN toxic = 1 THEN concat_ws(',', lang, source) ELSE '' END AS options, 0 AS correct_index, NULL AS distractor_types, '' AS seed_paper_id, '' AS seed_arxiv_id, '' AS seed_title,
  '' AS gold_paper_ids, '' AS gold_arxiv_ids, '' AS bridge_paper_ids, '' AS bridge_arxiv_ids, toxic::VARCHAR AS filter_agreement FROM qa"""


def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers.order_stats(T.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p95": 0.95})


def retry_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.calls(spark, sf_dir).groupBy("sample").agg(F.count_if(F.col("tool") == "think").alias("retries"))
    return report.retry_histogram(d)


# A few price rows in order: prefix, dollars per million in and out, factors for cache reads and writes.
PRICES = [(0, "ECONOMY", 5.0, 25.0, 0.1, 1.25), (1, "STANDARD", 3.0, 15.0, 0.1, 1.25), (2, "PRO", 2.0, 9.0, 0.2, 1.0), (3, "PROMO", 1.25, 10.0, 0.5, 1.0), (4, "S", 0.4, 1.6, 0.5, 1.0)]


def cost_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.operators.joins import prefix_join

    use = T.table(spark, sf_dir, "lineitem").join(T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("model")), "l_partkey")
    per = use.groupBy("model").agg(F.sum("l_quantity").alias("prompt"), F.count("*").cast("double").alias("completion"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("reads"), F.count_if(F.col("l_returnflag") == "A").cast("double").alias("writes"))
    dim = spark.createDataFrame(PRICES, "ord int, prefix string, in_per_m double, out_per_m double, read_mult double, write_mult double")
    d = prefix_join(per, "model", dim, longest=False).where("prefix IS NOT NULL")
    price = F.struct("in_per_m", "out_per_m", "read_mult", "write_mult")
    return d.withColumn("c", report.cost(F.col("prompt"), F.col("completion"), F.col("reads"), F.col("writes"), price)).select("model", "prefix", "c.*")


def budget_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("sample").orderBy("ts", "event_id")
    d = T.calls(spark, sf_dir).withColumn("n", F.row_number().over(w) - 1).withColumn("turn", F.floor(F.col("n") / 2).cast("int"))
    folded = replay.calls_of(d, "sample", ["n"]).withColumn("s", replay.budget_machine("calls"))
    return folded.select("sample", "s.left", "s.ran", "s.rejected", "s.run", "s.submitted", "s.stopped")


_COST_SQL = "CASE x.tool " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in replay.TOOL_COSTS.items()) + " ELSE 0 END"
BUDGET_SQL = f"""
WITH RECURSIVE {T.CALLS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY ts, event_id) - 1 AS n FROM calls),
x AS (SELECT sample, n, n // 2 AS turn, tool, ({_COST_SQL.replace("x.tool", "tool")}) AS cost FROM o),
m(sample, n, lft, ran, rejected, run, submitted, stopped, turn) AS (
  SELECT DISTINCT sample, -1::BIGINT, 30, 0, 0, 0, false, false, -1::BIGINT FROM x
  UNION ALL
  SELECT m.sample, x.n,
    CASE WHEN h THEN lft WHEN over THEN lft ELSE lft - cost END, CASE WHEN h OR over THEN ran ELSE ran + 1 END,
    CASE WHEN NOT h AND over THEN rejected + 1 ELSE rejected END, CASE WHEN h THEN run WHEN over THEN run + 1 ELSE 0 END,
    CASE WHEN h OR over THEN submitted ELSE submitted OR tool = 'submit_answer' END, h, CASE WHEN h THEN m.turn ELSE x.turn END
  FROM m JOIN x ON m.sample = x.sample AND x.n = m.n + 1,
  LATERAL (SELECT m.stopped OR (x.turn > m.turn AND (m.run >= 2 OR m.submitted)) AS h, x.cost > m.lft AND x.tool <> 'submit_answer' AS over))
SELECT sample, arg_max(lft, n) AS left, arg_max(ran, n) AS ran, arg_max(rejected, n) AS rejected, arg_max(run, n) AS run, arg_max(submitted, n) AS submitted, arg_max(stopped, n) AS stopped FROM m GROUP BY sample
"""


def token_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.calls(spark, sf_dir).withColumn("cents", F.round(F.col("tokens") * 100).cast("long"))
    return report.token_cap(d, "sample", ["ts", "event_id"], "cents", 100_000).select("sample", "event_id", "used", "over")


def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.qa(spark, sf_dir).select("source", "doc_id", F.col("is_correct").cast("int").alias("ok"))
    d = ranges.running(d, "source", "doc_id", {"right": F.col("ok"), "seen": F.lit(1)})
    return d.select("source", "doc_id", F.round(F.col("right") / F.col("seen"), 4).alias("accuracy"))


def _reads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = T.calls(spark, sf_dir)
    section = F.concat(F.lit("Section "), (F.col("paper") % 5).cast("string"), F.lit(" Results"))
    reads = c.where("tool = 'read_section'").select("sample", F.col("event_id").alias("read"), F.col("paper").cast("string").alias("paper"), section.alias("section"))
    s = c.groupBy("sample").agg(F.count_if(F.col("tool") == "submit_answer").alias("k"), F.bool_or(F.col("tool") == "search_papers").alias("used_search"))
    ids = lambda off, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: ((F.col("sample") + off + i * 7) % 100).cast("string"))
    s = s.select("sample", (F.col("k") % 2 == 1).alias("is_correct"), ids(0, 12).alias("gold"), ids(3, 8).alias("bridges"), "used_search")
    labels = s.select("sample", F.posexplode("gold").alias("pos", "paper")).select("sample", "paper", "pos", F.concat(F.lit("section "), (F.col("pos") % 5).cast("string")).alias("section"), F.when(F.col("pos") % 3 == 0, "direct").otherwise("supporting").alias("relevance"))
    return s, reads, labels


_READS = f"""{T.CALLS_SQL},
reads AS (SELECT sample, event_id AS read, paper::VARCHAR AS paper, 'section ' || (paper % 5) || ' results' AS section FROM calls WHERE tool = 'read_section'),
s AS (SELECT sample, count_if(tool = 'submit_answer') % 2 = 1 AS is_correct, bool_or(tool = 'search_papers') AS used_search,
  list_transform(range(0, 12), lambda i: ((sample + i * 7) % 100)::VARCHAR) AS gold, list_transform(range(0, 8), lambda i: ((sample + 3 + i * 7) % 100)::VARCHAR) AS bridges FROM calls GROUP BY sample),
labels_ AS (SELECT sample, unnest(gold) AS paper, generate_subscripts(gold, 1) - 1 AS pos FROM s),
lab AS (SELECT *, 'section ' || (pos % 5) AS section, pos % 3 = 0 AS direct FROM labels_),
r AS (SELECT reads.*, list_contains(gold, paper) AS g, list_contains(bridges, paper) AS b FROM reads JOIN s USING (sample))"""


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.retrieval(*_reads(spark, sf_dir))


def navigation_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, reads, _ = _reads(spark, sf_dir)
    r = reads.join(s.select("sample", "gold", "bridges"), "sample")
    g = F.array_contains("gold", F.col("paper"))
    per = r.groupBy("sample").agg(F.count_distinct(F.when(g, F.col("paper"))).alias("targets"), F.count_distinct(F.when(~g & F.array_contains("bridges", F.col("paper")), F.col("paper"))).alias("bridges"))
    d = s.drop("bridges").join(per, "sample", "left").select(
        F.when(F.col("sample") % 2 == 0, "multi-target").otherwise("single-target").alias("question_type"), (F.floor(F.col("sample") / 2) % 2 + 1).cast("int").alias("depth"),
        F.coalesce("targets", F.lit(0)).alias("targets"), F.coalesce("bridges", F.lit(0)).alias("bridges"), F.lit(2).alias("all_targets"), "used_search", "is_correct",
    )
    return report.navigation(d)


QUERIES = {
    "bucket_accuracy_sets": (bucket_accuracy_sets, f"WITH {T.QA_SQL} SELECT lang, source, {_ACC} FROM qa GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())"),
    "accuracy_by_source_outer": (accuracy_by_source_outer, f"WITH {T.QA_SQL} SELECT source, count(*) AS n, count(quality) AS labelled, {_RATE.format('count_if(is_correct)', 'count(quality)')} AS accuracy FROM qa GROUP BY source"),
    "accuracy_by_tristate": (accuracy_by_tristate, f"WITH {T.QA_SQL} SELECT CASE WHEN toxic = 1 THEN 'necessary' WHEN toxic IS NULL THEN 'unlabeled' ELSE 'optional' END AS bridge, {_ACC} FROM qa WHERE lang = 'en' AND doc_id % 2 + 1 = 2 GROUP BY 1"),
    "position_bias": (position_bias, f"WITH {_PRED} SELECT letter, count_if(pred = i) AS predicted, count_if(cor = i) AS correct_at, {_RATE.format('count_if(cor = i AND ok)', 'count_if(cor = i)')} AS accuracy FROM q, (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D')) t(i, letter) GROUP BY letter"),
    "failure_attribution": (failure_attribution, f"""WITH {_PRED},
w AS (SELECT CASE WHEN pred < 0 THEN 'no_answer' WHEN pred > 3 OR doc_id % 11 = 0 THEN 'unknown' ELSE ['seed_only', 'wrong_paper', 'no_context'][(pred + doc_id) % 3 + 1] END AS failure FROM q WHERE NOT ok)
SELECT failure, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS rate FROM w GROUP BY failure"""),
    "tool_usage": (tool_usage, f"""WITH {T.CALLS_SQL}, x AS (SELECT *, {_COST_SQL.replace("x.tool", "tool")} AS cost, tokens > 20 AS rejected FROM calls)
SELECT tool, count(*) AS calls, round(count(*) / (SELECT count(DISTINCT sample) FROM x), 4) AS per_sample, sum(cost)::BIGINT AS budget, {_RATE.format('sum(cost)', 'sum(sum(cost)) OVER ()')} AS budget_share, {_RATE.format('count_if(rejected)', 'count(*)')} AS rejection_rate FROM x GROUP BY tool"""),
    "turn_profile": (turn_profile, f"WITH {T.CALLS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY ts, event_id) - 1 AS k FROM calls) SELECT k, count(*) AS n, avg(round(tokens * 100)::BIGINT) AS mean FROM o GROUP BY k"),
    "sample_rows": (sample_rows, SAMPLES_SQL),
    "order_statistics": (order_statistics, """WITH o AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(n) AS n, round(avg(v), 2) AS mean, max(v) FILTER (WHERE i = floor(0.5 * n)) AS p50, max(v) FILTER (WHERE i = least(floor(0.9::DOUBLE * n), n - 1)) AS p90, max(v) FILTER (WHERE i = least(floor(0.95::DOUBLE * n), n - 1)) AS p95 FROM o GROUP BY 1"""),
    "retry_histogram": (retry_histogram, f"WITH {T.CALLS_SQL}, s AS (SELECT sample, count_if(tool = 'think') AS retries FROM calls GROUP BY 1) SELECT retries, count(*) AS n, sum(retries)::BIGINT AS total FROM s GROUP BY 1"),
    "cost_breakdown": (cost_breakdown, "WITH pr(ord, prefix, a, b, r, w) AS (VALUES " + ", ".join(f"({o}, '{p}', {a}::DOUBLE, {b}::DOUBLE, {r}::DOUBLE, {w}::DOUBLE)" for o, p, a, b, r, w in PRICES) + """),
u AS (SELECT p_type AS model, sum(l_quantity) AS p, count(*)::DOUBLE AS c, count_if(l_returnflag = 'R')::DOUBLE AS rd, count_if(l_returnflag = 'A')::DOUBLE AS wr FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
j AS (SELECT u.*, pr.*, row_number() OVER (PARTITION BY model ORDER BY ord) AS k FROM u JOIN pr ON starts_with(model, prefix))
SELECT model, prefix, round(p * a / 1e6, 6) AS regular_input_usd, round(rd * a * r / 1e6, 6) AS cache_read_usd, round(wr * a * w / 1e6, 6) AS cache_creation_usd, round(c * b / 1e6, 6) AS output_usd,
  round(p * a / 1e6 + rd * a * r / 1e6 + wr * a * w / 1e6 + c * b / 1e6, 6) AS total_usd FROM j WHERE k = 1"""),
    "budget_replay": (budget_replay, BUDGET_SQL),
    "token_cap": (token_cap, f"WITH {T.CALLS_SQL}, o AS (SELECT sample, event_id, sum(round(tokens * 100)::BIGINT) OVER (PARTITION BY sample ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM calls) SELECT *, used > 100000 AS over FROM o"),
    "running_accuracy": (running_accuracy, f"WITH {T.QA_SQL} SELECT source, doc_id, round(avg(is_correct::INT) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING), 4) AS accuracy FROM qa"),
    "retrieval_metrics": (retrieval_metrics, f"""WITH {_READS},
h AS (SELECT r.sample, r.read, arg_min(direct, pos) AS direct FROM r JOIN lab ON r.sample = lab.sample AND r.paper = lab.paper AND r.g AND contains(r.section, lab.section) GROUP BY 1, 2),
hs AS (SELECT sample, bool_or(direct) AS hard, true AS soft FROM h GROUP BY 1),
ps AS (SELECT sample, count(*) AS reads, count_if(NOT g AND NOT b) AS wasted, bool_or(g) AS reached FROM r GROUP BY 1)
SELECT count(*) AS n, round(count_if(coalesce(reached, false)) / count(*), 4) AS paper_recall, round(count_if(coalesce(hard, false)) / count(*), 4) AS section_recall_hard, round(count_if(coalesce(soft, false)) / count(*), 4) AS section_recall_soft,
  {_RATE.format("count_if(coalesce(reached, false) AND is_correct)", "count_if(coalesce(reached, false))")} AS conversion, {_RATE.format("sum(wasted)", "sum(reads)")} AS wasted_rate
FROM s LEFT JOIN ps USING (sample) LEFT JOIN hs USING (sample)"""),
    "navigation_patterns": (navigation_patterns, f"""WITH {_READS},
c AS (SELECT sample, count(DISTINCT paper) FILTER (WHERE g) AS t, count(DISTINCT paper) FILTER (WHERE NOT g AND b) AS b FROM r GROUP BY 1),
k AS (SELECT sample % 2 = 0 AS multi, sample // 2 % 2 + 1 AS depth, coalesce(c.t, 0) AS t, coalesce(c.b, 0) AS b, used_search AS u, is_correct, CASE WHEN coalesce(c.t, 0) >= 2 THEN 'reached_all' ELSE 'reached_' || coalesce(c.t, 0) || '_of_2' END AS reach FROM s LEFT JOIN c USING (sample)),
z AS (SELECT is_correct, CASE WHEN multi THEN 'mt_d' || depth WHEN depth = 2 THEN 'st_d2' ELSE 'st_d1' END AS grp,
  CASE WHEN multi AND depth = 1 THEN CASE WHEN t = 0 THEN 'reached_0' ELSE reach END
       WHEN multi THEN CASE WHEN t = 0 AND b > 0 THEN 'reached_0_bridge' WHEN t = 0 THEN 'reached_0' ELSE reach || '__' || CASE WHEN b > 0 THEN 'via_bridge' WHEN u THEN 'via_search' ELSE 'via_seed_cite' END END
       WHEN depth = 2 THEN CASE WHEN b > 0 AND t > 0 THEN 'bridge_and_target' WHEN t > 0 THEN CASE WHEN u THEN 'target_only_via_search' ELSE 'target_only_skipped_bridge' END WHEN b > 0 THEN 'bridge_only' ELSE 'neither' END
       ELSE CASE WHEN t > 0 THEN 'reached_target' ELSE 'missed' END END AS bucket FROM k)
SELECT grp, bucket, {_ACC}, {_RATE.format("count(*)", "sum(count(*)) OVER (PARTITION BY grp)")} AS share FROM z GROUP BY grp, bucket"""),
}
