"""Queries of the construction steps, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import replies as R
from quillgraph.operators import construction as C
from quillgraph.plans import tables as T
from quillgraph.plans.graphs import SCORED_SQL, _scored, _seeds


def eligible_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders")
    p = o.select(F.concat(F.lit("p"), F.col("o_custkey")).alias("paperId"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey").cast("string")).otherwise("").alias("arxivId"), F.when(F.col("o_orderkey") % 9 == 0, "An Overview").otherwise("A net").alias("title"), (F.col("o_orderkey") % 70).cast("int").alias("referenceCount"), F.when(F.col("o_orderkey") % 10 == 0, F.array(F.lit("Review"))).alias("publicationTypes"), F.col("o_orderkey").alias("pos"))
    gone = T.table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.concat(F.lit("p"), F.col("c_custkey")).alias("paperId"))
    return C.eligible_seeds(p, gone).select("paperId", "pos", "referenceCount")


def trim_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tier"), F.round(F.col("o_totalprice") * 100).cast("long").alias("coverage"), F.col("o_orderkey").alias("pos"))
    t = spark.createDataFrame([("1-URGENT", 50), ("2-HIGH", 30), ("5-LOW", 20)], "tier string, target int")
    return C.trim_tiers(s, t)


def fixed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).select("src", "dst", "pos", "score")
    back = s.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score").withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).select("src", "dst", "pos", "score")
    return C.fixed_chains(s.unionByName(back), _seeds(spark, sf_dir))


CHAINS_SQL = f"""WITH {SCORED_SQL},
b AS (SELECT src, dst, pos, score FROM sc UNION ALL SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src), score FROM sc),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, pos) AS k FROM b),
x AS MATERIALIZED (SELECT src, dst, score FROM r WHERE k <= 10 AND src IN (SELECT 'S' || s_suppkey FROM supplier)),
y AS MATERIALIZED (SELECT src, dst, score FROM r WHERE k <= 5)
SELECT x.src AS seed, x.dst AS hop1, y.dst AS hop2, (x.score + y.score)::DOUBLE AS chain_score FROM x JOIN y ON y.src = x.dst AND y.dst <> x.src"""

_KINDS = [*C.PROMISING, *C.WEAK, "unclassified"]


def chain_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda m: F.element_at(F.array(*map(F.lit, _KINDS)), (F.floor(F.col("o_orderkey") / m) % 8 + 1).cast("int"))
    j = (F.col("o_custkey") % 20) / 100
    d = T.table(spark, sf_dir, "orders").select("o_orderkey", C.chain_decision(j, pick(1), pick(8)).alias("decision"), C.chain_decision(j, pick(1), pick(8), with_model=True).alias("queued"), C.recent_enough(F.when(F.col("o_orderkey") % 3 > 0, F.year("o_orderdate")), 1997).alias("recent"))
    return d


_ARR = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"
DECISIONS_SQL = f"""WITH d AS (SELECT o_orderkey, o_custkey % 20 / 100 AS j, o_orderkey % 8 AS a, o_orderkey // 8 % 8 AS b, NOT coalesce(CASE WHEN o_orderkey % 3 > 0 THEN year(o_orderdate) END < 1997, false) AS recent FROM orders)
SELECT o_orderkey, CASE WHEN a IN (5, 6) AND b IN (5, 6) THEN 'drop_l2' WHEN a < 5 AND b < 5 AND j >= 0.08 THEN 'keep_no_llm' WHEN a < 5 AND b < 5 THEN 'keep_no_llm_marginal' ELSE 'drop_no_llm' END AS decision,
  CASE WHEN a IN (5, 6) AND b IN (5, 6) THEN 'drop_l2' ELSE 'pending_llm' END AS queued, recent FROM d"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders")
    key = lambda c, m: F.concat(F.lit("p"), c % m)
    c = o.select(key(F.col("o_orderkey"), 97).alias("seed"), F.array(key(F.col("o_custkey"), 301), key(F.col("o_orderkey"), 501)).alias("path"), key(F.col("o_custkey"), 901).alias("terminal"))
    return C.inventory(c)


def valid_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.concat("p_name", F.lit(" "), "p_size", F.lit(" of "), F.col("p_partkey") % 40).alias("name"))
    d = d.join(p, "p")
    a = d.where("l_linenumber = 1").select(F.col("l_orderkey").alias("qid"), F.col("name").alias("answer"))
    c = d.where("l_linenumber > 1").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("ord"), F.lit("k").alias("kind"), F.concat(F.lit(" "), F.initcap("name")).alias("text"))
    return C.valid_distractors(c.join(a, "qid"), needed=2).select("qid", "ord", "text", "valid")


DISTRACTORS_SQL = r"""WITH d AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
n AS (SELECT d.*, p_name || ' ' || p_size || ' of ' || (p_partkey % 40) AS name FROM d JOIN part ON p = p_partkey),
c AS (SELECT x.l_orderkey AS qid, x.l_linenumber AS ord, x.name AS t, a.name AS a FROM n x JOIN n a ON x.l_orderkey = a.l_orderkey AND a.l_linenumber = 1 WHERE x.l_linenumber > 1),
w AS (SELECT *, list_distinct(string_split(t, ' ')) AS tw, list_distinct(string_split(a, ' ')) AS aw, list_filter(list_distinct(regexp_extract_all(a, '\d+\.?\d*')), lambda x: x NOT IN ('0','1','2','3','4','5')) AS an, list_filter(list_distinct(regexp_extract_all(t, '\d+\.?\d*')), lambda x: x NOT IN ('0','1','2','3','4','5')) AS tn FROM c),
o AS (SELECT * FROM w WHERE t <> a AND len(list_intersect(tw, aw)) / len(list_distinct(list_concat(tw, aw))) <= 0.6 AND (len(an) < 2 OR len(tn) < 2 OR len(list_intersect(an, tn)) / len(an) <= 0.5)),
f AS (SELECT qid, min(ord) AS ord, t FROM o GROUP BY qid, t)
SELECT qid, ord, array_to_string(list_transform(string_split(t, ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS text, valid FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS valid FROM f) WHERE valid >= 2"""


def fold_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.calls(spark, sf_dir).groupBy("sample", "tool").agg(F.count("*").alias("calls"), F.sum(F.round(F.col("tokens") * 100).cast("long")).alias("cents"))
    a = e.withColumn("attempt", F.row_number().over(Window.partitionBy("sample").orderBy("tool")) - 1)
    return C.fold_retries(a.select("sample", "attempt", "calls", "cents", F.col("tool").alias("ended_by")), ["calls", "cents"])


_REPLIES = ["A", "the answer is b", "I would select \"C\" here", "so: D)", "nothing", "b ", "option A or B"]


def reply_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    arr = F.array(*map(F.lit, _REPLIES))
    d = T.table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(arr, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("x"), F.element_at(arr, (F.floor(F.col("o_orderkey") / 7) % 7 + 1).cast("int")).alias("y"))
    return d.select("o_orderkey", R.answer_of(F.array("x", "y")).alias("answer"), R.json_part(F.concat(F.lit("ok {\"a\": "), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")), F.lit("} end"))).alias("json"))


ANSWERS_SQL = """WITH d AS (SELECT o_orderkey, o_orderkey % 7 AS x, o_orderkey // 7 % 7 AS y FROM orders),
p AS (SELECT *, [ 'A', NULL, NULL, NULL, NULL, 'B', NULL][x + 1] AS lx, ['A', NULL, NULL, NULL, NULL, 'B', NULL][y + 1] AS ly, [NULL, 'B', 'C', 'D', NULL, 'B', 'A'][x + 1] AS px, [NULL, 'B', 'C', 'D', NULL, 'B', 'A'][y + 1] AS py FROM d)
SELECT o_orderkey, coalesce(lx, ly, px, py) AS answer, CASE WHEN o_orderkey % 2 = 0 THEN '{"a": ' || o_orderkey || '}' END AS json FROM p"""


QUERIES = {
    "eligible_seeds": (eligible_seeds, "WITH p AS (SELECT 'p' || o_custkey AS id, o_custkey, o_orderkey AS pos, o_orderkey % 70 AS r FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey % 9 <> 0 AND o_orderkey % 10 <> 0 AND o_orderkey % 70 BETWEEN 15 AND 50 AND o_custkey % 5 <> 0) SELECT id AS \"paperId\", min(pos) AS pos, arg_min(r, pos) AS \"referenceCount\" FROM p GROUP BY id"),
    "trim_tiers": (trim_tiers, "WITH t(tier, target) AS (VALUES ('1-URGENT', 50), ('2-HIGH', 30), ('5-LOW', 20)), r AS (SELECT o_orderpriority AS tier, round(o_totalprice * 100)::BIGINT AS coverage, o_orderkey AS pos, row_number() OVER (PARTITION BY o_orderpriority ORDER BY round(o_totalprice * 100)::BIGINT DESC, o_orderkey) AS place FROM orders) SELECT r.* FROM r JOIN t USING (tier) WHERE place <= target"),
    "fixed_chains": (fixed_chains, CHAINS_SQL),
    "chain_decisions": (chain_decisions, DECISIONS_SQL),
    "inventory": (inventory, "WITH o AS (SELECT * FROM orders), u AS (SELECT 'p' || o_orderkey % 97 AS id, 0 AS o, 'seed' AS role, 0 AS depth FROM o UNION ALL SELECT 'p' || o_custkey % 301, 1, 'path', 1 FROM o UNION ALL SELECT 'p' || o_orderkey % 501, 1, 'path', 2 FROM o UNION ALL SELECT 'p' || o_custkey % 901, 2, 'terminal', 3 FROM o) SELECT id, arg_min(role, o) AS role, min(depth) AS depth, count(*) AS uses FROM u GROUP BY id".replace("'p' || o_orderkey % 97", "'p' || (o_orderkey % 97)").replace("'p' || o_custkey % 301", "'p' || (o_custkey % 301)").replace("'p' || o_orderkey % 501", "'p' || (o_orderkey % 501)").replace("'p' || o_custkey % 901", "'p' || (o_custkey % 901)")),
    "valid_distractors": (valid_distractors, DISTRACTORS_SQL),
    "fold_retries": (fold_retries, f"WITH {T.CALLS_SQL}, e AS (SELECT sample, tool, count(*) AS calls, sum(round(tokens * 100)::BIGINT)::BIGINT AS cents FROM calls GROUP BY 1, 2) SELECT sample, count(*) - 1 AS retry_count, sum(calls)::BIGINT AS calls, sum(cents)::BIGINT AS cents, max(tool) AS ended_by FROM e GROUP BY 1"),
    "reply_answers": (reply_answers, ANSWERS_SQL),
}
