"""Queries of the report, seeds, tool messages, triage and prompts, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import access, evaluation, graph, joins, messages, prompts, seeds, triage
from quillgraph.plans import tables as T



def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's one nested row, shown as its figures."""
    one = evaluation.evaluation(T.runs(spark, sf_dir), {"model": "m"})
    d = one.select(F.explode("sections").alias("section", "figures")).select("section", F.explode("figures").alias("key", "f"))
    return d.select("section", "key", "f.n", "f.correct", F.round("f.value", 4).alias("value"))


def _bucket(section: str, key: str, where: str = "true") -> str:
    return f"SELECT '{section}' AS section, {key} AS key, count(*) AS n, count_if(ok) AS correct, round(count_if(ok) / count(*), 4)::DOUBLE AS value FROM runs WHERE {where} GROUP BY 2"


def _figure(section: str, key: str, n: str, value: str) -> str:
    return f"SELECT '{section}', '{key}', ({n})::BIGINT, 0, round(({value})::DOUBLE, 4) FROM runs"


def _place(c: str, p: float) -> str:
    return f"list_sort(list({c}))[least(floor({p} * count(*)), count(*) - 1)::BIGINT + 1]"


_LETTER = "chr(65 + {}::INT)"
REPORT_SQL = f"WITH {T.RUNS_SQL}, u AS (" + " UNION ALL ".join([
    _bucket("by_type", "question_type"), _bucket("by_depth", "'d' || depth"), _bucket("by_reasoning", "reasoning_type"), _bucket("by_venue", "venue"), _bucket("by_tier", "coalesce(tier, '?')"),
    _bucket("by_agreement", "'agree_' || filter_agreement"), _bucket("by_bridge", "CASE bridge_necessary WHEN true THEN 'necessary' WHEN false THEN 'optional' ELSE 'unlabeled' END", "question_type = 'multi-target' AND depth = 2"),
    _bucket("by_termination", "terminated_by"), _bucket("predicted", _LETTER.format("predicted_index"), "predicted_index BETWEEN 0 AND 3"), _bucket("correct_position", _LETTER.format("correct_index")),
    _bucket("retry_count", "retry_count::VARCHAR"), _bucket("overall", "'all'"),
    "SELECT 'failure', key, count(*), 0, round(count(*) / sum(count(*)) OVER (), 4) FROM (SELECT CASE WHEN predicted_index < 0 THEN 'no_answer' WHEN predicted_index IN (1, 4) THEN 'unknown' ELSE ['seed_only', '', 'wrong_paper', 'no_context'][predicted_index + 1] END AS key FROM runs WHERE NOT ok) GROUP BY key",
    *(_figure("tokens", k, f"sum({c})", f"round(sum({c}) / count(*), 1)") for k, c in (("regular_input", "prompt"), ("cache_read", "cread"), ("cache_creation", "ccreate"), ("completion", "completion"))),
    _figure("tokens", "total_input", "sum(prompt + cread + ccreate)", "sum(cread) / sum(prompt + cread + ccreate)"),
    *(_figure("errors", k, f"sum({c})", "0") for k, c in (("api_error_total", "api"), ("transient_retry_total", "transient"), ("tool_call_error_total", "terr"))),
    *(_figure("means", k, "count(*)", f"round(avg({c}), 1)") for k, c in (("budget", "budget"), ("turns", "total_turns"), ("wall_time", "wall"), ("prompt", "prompt"), ("completion", "completion"))),
    *(_figure(s, k, "count(*)", f"round(avg({c}), 2)" if k == "mean" else _place(c, p)) for s, c in (("turns", "total_turns"), ("wall_time", "wall")) for k, p in (("mean", 0), ("p50", 0.5), ("p90", 0.9), ("p95", 0.95))),
]) + ") SELECT section, key, n, correct::BIGINT AS correct, value FROM u"


def retry_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.retry_lists(T.runs(spark, sf_dir))


RETRY_SQL = f"""WITH {T.RUNS_SQL} SELECT 'transient' AS list, sample_id FROM runs WHERE transient > 0 UNION ALL SELECT CASE WHEN terminated_by = 'error' THEN 'failed' ELSE 'succeeded' END, sample_id FROM runs WHERE retry_count > 0"""


def filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c: F.element_at(F.array(*map(F.lit, ("comparison", "evolution", "background_cite"))), (c % 3 + 1).cast("int"))
    o = T.table(spark, sf_dir, "orders")
    return evaluation.filter_report(o.select(F.when(F.col("o_orderkey") % 4 == 0, "drop").otherwise("keep").alias("decision"), pick(F.col("o_orderkey")).alias("type1"), pick(F.col("o_custkey")).alias("type2"), (F.col("o_custkey") % 64 / 64).alias("jaccard")))


FILTER_SQL = """WITH c AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'drop' ELSE 'keep' END AS d, ['comparison', 'evolution', 'background_cite'][o_orderkey % 3 + 1] AS a, ['comparison', 'evolution', 'background_cite'][o_custkey % 3 + 1] AS b, o_custkey % 64 / 64 AS j FROM orders)
SELECT 'decision' AS section, d AS key, count(*) AS n, 0.0::DOUBLE AS value FROM c GROUP BY d UNION ALL SELECT 'pair', a || '+' || b, count(*), 0 FROM c GROUP BY 2
UNION ALL SELECT 'type', t, count(*), 0 FROM (SELECT a AS t FROM c UNION ALL SELECT b FROM c) GROUP BY t
UNION ALL SELECT 'jaccard', 'min', count(*), min(j) FROM c UNION ALL SELECT 'jaccard', 'max', count(*), max(j) FROM c UNION ALL SELECT 'jaccard', 'median', count(*), list_sort(list(j))[least(floor(0.5 * count(*)), count(*) - 1)::BIGINT + 1] FROM c"""


def chain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain scores by depth: how many, least, middle, greatest."""
    d = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("depth"), F.sum(F.col("l_quantity").cast("long")).alias("score"))
    return evaluation.spread(d, "depth", "score")


STATS_SQL = """WITH d AS (SELECT l_orderkey, count(*) AS depth, sum(l_quantity::BIGINT) AS score FROM lineitem GROUP BY 1),
s AS (SELECT depth, count(*) AS n, min(score) AS lo, max(score) AS hi, list_sort(list(score))[least(floor(0.5 * count(*)), count(*) - 1)::BIGINT + 1] AS mid FROM d GROUP BY 1)
SELECT depth::VARCHAR AS section, k AS key, n, v::DOUBLE AS value FROM (SELECT depth, n, unnest(['min', 'median', 'max']) AS k, unnest([lo, mid, hi]) AS v FROM s)"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type:verdict, by tier and by claim band, each as key and n."""
    r = T.runs(spark, sf_dir)
    a = evaluation.tally(r, F.col("question_type"), F.col("terminated_by"))
    return a.unionByName(evaluation.tally(r, F.lit("tier"), F.coalesce("tier", F.lit("none")))).unionByName(evaluation.tally(r, F.lit("venue"), F.col("venue")))


def role_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.means_by(T.table(spark, sf_dir, "part"), "p_type", ["p_size", "p_partkey"])


def slim_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 > 0, F.col("text")).alias("abstract"), F.col("text").alias("full"), F.coalesce(F.substring("text", 1, 40), F.lit("")).alias("slim"))
    return evaluation.coverage(d, "abstract", "full", "slim")


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("p"), F.col("o_custkey")).alias("paperId"), F.concat(F.lit("x"), F.col("o_orderkey")).alias("arxivId"), F.when(F.col("o_orderkey") % 9 == 0, "A Survey").otherwise("A net").alias("title"), (F.col("o_orderkey") % 70).cast("int").alias("referenceCount"),
        F.array(F.lit("Journal")).alias("publicationTypes"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("venue"), F.year("o_orderdate").alias("year"), (F.col("o_orderkey") * 7 % 1000).alias("citationCount"),
    )


_VENUES = ["5-LOW", "1-URGENT", "3-MEDIUM"]


def tier_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = T.table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.concat(F.lit("p"), F.col("c_custkey")).alias("paperId"))
    return seeds.tier_seeds(_papers(spark, sf_dir), gone, (1993, 1998), 100, 50, _VENUES).select("paperId", "venue", "pos")


TIER_SQL = """WITH p AS (SELECT 'p' || o_custkey AS id, o_orderkey AS pos, o_orderpriority AS venue, o_orderkey * 7 % 1000 AS cites, list_position(['5-LOW', '1-URGENT', '3-MEDIUM'], o_orderpriority) AS v FROM orders
  WHERE o_orderpriority IN ('5-LOW', '1-URGENT', '3-MEDIUM') AND year(o_orderdate) BETWEEN 1993 AND 1998 AND o_orderkey * 7 % 1000 >= 100 AND o_orderkey % 70 BETWEEN 15 AND 50 AND o_orderkey % 9 <> 0 AND o_custkey % 5 <> 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v, pos) AS n FROM p) WHERE n = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY cites DESC, v, pos) > greatest(1, 50 // (SELECT count(DISTINCT venue) FROM f)) AS filled FROM f)
SELECT id AS "paperId", venue, pos FROM r ORDER BY filled, cites DESC, v, pos LIMIT 50"""


def search_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.search_bulk(_papers(spark, sf_dir), "2-HIGH", (1994, 1997), 300, pages=2, per_page=100).select("paperId", "pos", "year", "citationCount")


def narrowing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order from the narrowest of three field sets that has any."""
    d = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", "l_returnflag", "l_quantity")
    sets = [d.where("l_returnflag = 'R' AND l_quantity > 30"), d.where("l_quantity > 20").drop("l_returnflag"), d.select("id", "l_partkey")]
    return seeds.first_nonempty(T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", sets).groupBy("id", "source").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"), F.count("l_quantity").alias("quantities"))


NARROW_SQL = """WITH u AS (SELECT l_orderkey AS id, 0 AS source, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30 UNION ALL SELECT l_orderkey, 1, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 20 UNION ALL SELECT l_orderkey, 2, l_partkey, NULL FROM lineitem),
b AS (SELECT id, min(source) AS source FROM u GROUP BY id) SELECT id, source, count(*) AS n, sum(l_partkey)::BIGINT AS parts, count(l_quantity) AS quantities FROM u JOIN b USING (id, source) JOIN orders ON o_orderkey = id GROUP BY 1, 2"""


def page_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their first address, else by a second one; only long pages that were served count."""
    d = T.table(spark, sf_dir, "pages")
    status = F.when(F.col("page_id") % 3 == 0, 404).otherwise(200)
    page = seeds.fetched(F.col("html"), status, F.concat("html", "url"), F.lit(200))
    return d.select("page_id", F.length(page).alias("n_chars"))


def paper_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arXiv ids from two fields, venues under short names, and fields of other papers by id."""
    p = T.table(spark, sf_dir, "part")
    external = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("ArXiv"), F.concat(F.lit("a"), "p_partkey"))).when(F.col("p_partkey") % 3 == 1, F.create_map(F.lit("ArXiv"), F.lit("")))
    d = p.select("p_partkey", seeds.arxiv_id(external, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("o"), "p_partkey"))).alias("arxiv"), seeds.renamed(F.col("p_type"), {"ECONOMY": "ECO", "SMALL": "S"}).alias("venue"))
    ids = p.select((F.col("p_partkey") + 3).alias("p_partkey"))
    return d.join(seeds.lookup(p.select("p_partkey", "p_size"), ids, "p_partkey", ["p_size"]), "p_partkey", "left")


def abstract_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.when(F.min("l_quantity") > 10, F.min("l_returnflag")).alias("abstract"))  # noqa: E741
    src = T.table(spark, sf_dir, "part").where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("abstract"))
    return seeds.missing_filled(l, "l_partkey", "abstract", src)


def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "lineitem")
    c = d.select(F.concat(F.lit("S"), "l_suppkey").alias("seed"), F.when(F.col("l_partkey") % 10 > 0, F.concat(F.lit("P"), "l_partkey")).alias("terminal"), F.lit(None).cast("string").alias("arxiv_id"), F.col("l_returnflag").alias("title"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return access.sibling_index(c.groupBy("seed", "terminal", "arxiv_id", "pos").agg(F.min("title").alias("title"))).select("seed", "terminal", "title")


def chain_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains by seed; the arXiv id of each seed by the first chain of its last file."""
    o = T.table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 3, "0")).alias("file"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_custkey") % 11 > 0, F.concat(F.lit("p"), F.col("o_custkey") % 40)).alias("seed"), F.concat(F.lit("x"), F.col("o_custkey") % 9).alias("arxiv_id"), (F.col("o_custkey") % 6).alias("score"), F.lit(None).cast("array<string>").alias("contexts"), F.lit(None).cast("array<string>").alias("context_types"), F.lit(None).cast("string").alias("terminal"))
    by = access.screened(access.by_seed(o)).groupBy("seed").agg(F.count("*").alias("chains"), F.max(F.size("contexts")).alias("contexts"), F.max("terminal").alias("terminal"))
    return by.join(access.seed_arxiv(o), "seed", "left")


VIEWS_SQL = """WITH o AS (SELECT lpad((o_orderkey % 97)::VARCHAR, 3, '0') AS file, o_orderkey AS pos, CASE WHEN o_custkey % 11 > 0 THEN 'p' || (o_custkey % 40) END AS seed, 'x' || (o_custkey % 9) AS a, o_custkey % 6 AS score FROM orders),
f AS (SELECT file, arg_min({'s': seed, 'a': a}, pos) AS x FROM o GROUP BY file), l AS (SELECT x.s AS seed, arg_max(x.a, file) AS arxiv_id FROM f WHERE x.s IS NOT NULL GROUP BY 1)
SELECT o.seed, count(*) AS chains, 0 AS contexts, '' AS terminal, any_value(l.arxiv_id) AS arxiv_id FROM o LEFT JOIN l ON o.seed = l.seed WHERE o.seed IS NOT NULL AND score >= 3 GROUP BY 1"""


def gold_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds and targets by question type, and the map of what is right."""
    d = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("l_partkey") % 5 > 0, F.concat(F.lit("P"), "l_partkey")).otherwise(""))).alias("targets"), F.concat(F.lit("S"), F.min("l_suppkey")).alias("s"), F.concat(F.lit("T"), F.max("l_suppkey")).alias("t"))
    seed, ids = access.question_ids(F.col("n") % 2 == 1, F.col("s"), F.when(F.col("n") > 1, F.col("t")), F.upper("s"), F.col("targets"))
    g = access.gold_map(d.where("n % 2 = 1").select(F.col("l_orderkey").alias("id"), F.col("s").alias("seed"), F.col("t").alias("terminal"), F.array("s", "t").alias("path")), d.where("n % 2 = 0").select(F.col("l_orderkey").alias("id"), F.col("s").alias("seed"), "targets", F.lit("x").alias("sources")))
    gold = g.select(F.col("id").alias("l_orderkey"), F.coalesce(F.size("path"), F.lit(0)).alias("path"), F.coalesce(F.array_join("targets", "|"), F.lit("")).alias("gold"))
    return d.select("l_orderkey", seed.alias("seed"), F.array_join(ids, "|").alias("ids")).join(gold, "l_orderkey").select("l_orderkey", "seed", "ids", F.greatest("path", F.lit(0)).alias("path"), "gold")


GOLD_SQL = """WITH d AS (SELECT l_orderkey, count(*) AS n, list_sort(list_distinct(list(CASE WHEN l_partkey % 5 > 0 THEN 'P' || l_partkey ELSE '' END))) AS g, 'S' || min(l_suppkey) AS s, 'T' || max(l_suppkey) AS t FROM lineitem GROUP BY 1)
SELECT l_orderkey, s AS seed, CASE WHEN n % 2 = 1 THEN CASE WHEN n > 1 THEN t ELSE '' END ELSE array_to_string(list_filter(g, lambda x: x <> ''), '|') END AS ids, CASE WHEN n % 2 = 1 THEN 2 ELSE 0 END AS path, CASE WHEN n % 2 = 0 THEN array_to_string(g, '|') ELSE '' END AS gold FROM d"""


def distractor_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Material for distractors per order; only orders that have all three kinds and content for all lines."""
    d = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"), F.max("l_suppkey").alias("s"), F.count("*").alias("n"))
    pool = T.table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size") % 9).alias("n_sections"))
    d = d.join(pool.withColumnRenamed("p_partkey", "p"), "p").withColumn("wrong", access.wrong_paper_text(F.when(F.col("s") % 4 > 0, F.col("p_name")), F.when(F.col("n") > 3, F.lit("a fact"))))
    d = d.withColumn("types", access.distractor_types(F.when(F.col("n_sections") > 1, F.col("p_name")), F.col("wrong")))
    full = access.all_with_content(T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", pool.withColumnRenamed("p_partkey", "l_partkey"))
    return d.where(access.has_all(F.col("types"), ["seed_only", "wrong_paper", "no_context"])).join(full, "l_orderkey").select("l_orderkey", F.md5("wrong").alias("wrong"), F.size("types").alias("types"))


CONTEXTS_SQL = """WITH d AS (SELECT l_orderkey, min(l_partkey) AS p, max(l_suppkey) AS s, count(*) AS n FROM lineitem GROUP BY 1), f AS (SELECT l_orderkey FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING bool_and(coalesce(p_size % 9, 0) > 0))
SELECT l_orderkey, md5(CASE WHEN n > 3 THEN '=== FACT FROM PAPER 1 ===' || chr(10) || 'a fact' || chr(10) || chr(10) || '=== PAPER 2 CONTENT ===' || chr(10) || p_name ELSE p_name END) AS wrong, 3 AS types FROM d JOIN part ON p = p_partkey JOIN f USING (l_orderkey) WHERE p_size % 9 > 1 AND s % 4 > 0"""


def loaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses as JSON text by id: the last of each id; rows without a question or with an error are left out."""
    e = T.table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 9 > 0, F.col("user_id")).alias("id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("no json").alias("raw"), F.col("event_type").alias("question"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    return access.keyed(access.answered(e), "id").select("id", "pos", "question", access.analysis(F.col("raw"), "k int")["k"].alias("k"))


def cache_and_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached results that are as many as wanted, and a batch's replies with the missing ones filled."""
    c = T.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("answer"))
    want = c.groupBy("label").agg((F.count("*") + F.when(F.col("label") == "5-LOW", 1).otherwise(0)).alias("size"))
    kept = access.cached_results(c, want)
    done = access.batch_results(T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx")), kept.select("idx", F.col("answer").alias("reply")), "none")
    return done.groupBy("reply").agg(F.count("*").alias("n"), F.sum("idx").alias("ids"))


def kill_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 1000).alias("tokens"))
    return access.killed(r, 1_000_000).groupBy("run").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


def deep_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one seed and first step; the best eight of each seed."""
    d = T.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("seed"), F.col("l_orderkey").alias("hop1"), F.concat(F.lit("P"), "l_partkey").alias("terminal"), F.array("l_returnflag", "l_linestatus").alias("contexts"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity").alias("o"))
    d = d.withColumn("pos", F.row_number().over(Window.partitionBy("seed", "hop1").orderBy("o")))
    p = graph.sibling_pairs(d, ["seed", "hop1"])
    return seeds.most_groups(p, ["seed"], [F.size("shared").desc(), F.col("hop1"), F.col("pos1"), F.col("pos2")]).select("seed", "hop1", "t1", "t2", "rank")


DEEP_SQL = """WITH d AS (SELECT l_suppkey % 50 AS seed, l_orderkey AS hop1, 'P' || l_partkey AS t, [l_returnflag, l_linestatus] AS c, row_number() OVER (PARTITION BY l_suppkey % 50, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS pos FROM lineitem),
p AS (SELECT a.seed, a.hop1, a.t AS t1, b.t AS t2, row_number() OVER (PARTITION BY a.seed ORDER BY least(len(list_intersect(a.c, b.c)), 2) DESC, a.hop1, a.pos, b.pos) AS rank FROM d a JOIN d b ON a.seed = b.seed AND a.hop1 = b.hop1 AND a.pos < b.pos AND a.t <> b.t)
SELECT * FROM p WHERE rank <= 8"""


def titles_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of a supplier's parts among its own parts; ids old and new; providers with an override."""
    d = T.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(T.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = d.select(F.col("l_suppkey").alias("sample"), F.col("p_partkey").alias("node"), F.col("p_partkey").alias("pos"), F.concat(F.initcap("p_name"), F.lit(" "), F.col("p_size")).alias("title"))
    s = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_suppkey").alias("sample"), F.element_at(F.array(F.lit("Small Ring 7"), F.lit("RED w"), F.lit("blue"), F.lit("nothing"), F.lit("")), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("title"))
    found = joins.title_in_scope(s, n, "sample")
    ids = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), (F.col("s_suppkey") + 40).cast("long").alias("new"), F.col("s_nationkey").cast("long").alias("old"), F.when(F.col("s_suppkey") % 4 == 0, "own").otherwise("").alias("given"), F.lower("s_name").alias("model"))
    named = joins.by_either_id(ids, T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("nation")), "new", "old", "k", "nation")
    dim = spark.createDataFrame([(i, p, v) for i, p, v in prompts.registry([("Supplier#0000000", "a"), ("SUPPLIER#00000000", "b"), ("supplier#00000", "c"), ("supplier#0000000", "d")])], "ord int, prefix string, provider string")
    return found.join(joins.provider_of(named, "model", dim, "given").select("qid", "nation", "provider"), "qid")


SCOPE_SQL = """WITH n AS (SELECT DISTINCT l_suppkey AS sample, p_partkey AS node, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || ' ' || p_size AS t FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT s_suppkey AS qid, ['Small Ring 7', 'RED w', 'blue', 'nothing', ''][s_suppkey % 5 + 1] AS q, s_nationkey, s_name FROM supplier),
m AS (SELECT qid, node, CASE WHEN t = q THEN 0 ELSE 1 END AS rank FROM s JOIN n ON sample = qid WHERE q <> '' AND (t = q OR contains(lower(t), lower(q[1:30])))),
b AS (SELECT qid, arg_min(node, (rank, node)) AS node, min(rank) AS rank FROM m GROUP BY qid)
SELECT s.qid, b.node, b.rank, coalesce(x.n_name, y.n_name) AS nation, CASE WHEN s.qid % 4 = 0 THEN 'own' WHEN lower(s_name) LIKE 'supplier#0000000%' THEN 'd' WHEN lower(s_name) LIKE 'supplier#00000%' THEN 'c' END AS provider
FROM s LEFT JOIN b USING (qid) LEFT JOIN nation x ON x.n_nationkey = s.qid + 40 LEFT JOIN nation y ON y.n_nationkey = s.s_nationkey"""


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event's tool answers about a part; every seventh call lacks its parameter."""
    c = T.calls(spark, sf_dir).join(T.table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "paper"), "paper", "left")
    pid = F.col("paper").cast("string")
    known = F.col("p_name").isNotNull() & (F.col("paper") % 5 > 0)
    heads = F.slice(F.array(*(F.struct(F.lit(h).alias("header"), F.col("p_name").alias("text")) for h in ("Introduction", "4.2. Results", "Our Method"))), 1, (F.col("paper") % 4).cast("int"))
    body = F.when(known & (F.col("paper") % 7 > 0), heads)
    args = F.when(F.col("event_id") % 7 == 0, F.create_map(F.lit("x"), F.lit("y"))).otherwise(F.create_map(F.lit("paper_id"), pid, F.lit("section"), F.lit("results"), F.lit("query"), F.lit("q"), F.lit("answer"), F.lit("B")))
    answers = {
        "get_paper_info": messages.paper_info(pid, known, F.col("p_name"), F.lit("Ann et al."), F.col("p_size"), F.when(F.col("paper") % 2 == 0, F.col("p_brand")).otherwise(""), body.isNotNull()),
        "search_papers": messages.section_list(pid, known, body, F.col("paper") % 2), "read_section": messages.section_text(pid, known, body, F.element_at(args, "section")),
    }
    d = messages.called(c.withColumn("args", args), answers, F.col("event_id") % 9)
    prompt = messages.system_prompt([("You have tools.", None), ("think: note something", "think"), ("read_section: read", "read_section")], F.when(F.col("event_id") % 2 == 0, F.array(F.lit("think"))).otherwise(F.array().cast("array<string>")))
    return d.select("event_id", F.md5("output").alias("output"), "cost", F.md5(messages.result_envelope(F.col("tool"), F.lit("ok"), F.col("event_id"))).alias("envelope"), F.length(prompt).alias("prompt"))


_NL = "chr(10)"
MESSAGES_SQL = f"""WITH {T.CALLS_SQL}, c AS (SELECT calls.*, p_name, p_size, p_brand, p_name IS NOT NULL AND paper % 5 > 0 AS known FROM calls LEFT JOIN part ON p_partkey = paper),
b AS (SELECT *, coalesce(known AND paper % 7 > 0, false) AS body, paper % 4 AS n, CASE tool WHEN 'read_section' THEN 5 WHEN 'get_paper_info' THEN 1 WHEN 'search_papers' THEN 1 ELSE 0 END AS price,
  event_id % 7 = 0 AS bare, 'Paper ''' || paper || ''' not found in the available paper pool.' AS nope, 'Full text not available for paper ''' || paper || '''.' AS notext, 'No sections found for paper ''' || paper || '''.' AS none FROM c),
o AS (SELECT *, price > event_id % 9 AND tool <> 'submit_answer' AS over,
  CASE WHEN tool = 'other' THEN 'Unknown tool: other'
  WHEN tool = 'get_paper_info' AND bare THEN 'Error calling get_paper_info: Missing or invalid parameter — ''paper_id'''
  WHEN tool = 'get_paper_info' AND known THEN 'Title: ' || p_name || {_NL} || 'Authors: Ann et al.' || {_NL} || 'Year: ' || p_size || {_NL} || 'Abstract: ' || CASE WHEN paper % 2 = 0 THEN p_brand ELSE '(not available)' END || {_NL} || 'Full text available: ' || CASE WHEN body THEN 'Yes' ELSE 'No' END
  WHEN tool = 'get_paper_info' THEN nope
  WHEN tool = 'search_papers' AND bare THEN 'Error calling search_papers: Missing or invalid parameter — ''query'''
  WHEN tool = 'search_papers' AND NOT body AND NOT known THEN nope WHEN tool = 'search_papers' AND NOT body THEN notext || ' Only abstract is available via get_paper_info.' WHEN tool = 'search_papers' AND n = 0 THEN none
  WHEN tool = 'search_papers' THEN 'Sections for paper ''' || paper || ''' (' || n || ' sections):' || {_NL} || {_NL} || array_to_string(['  (A) Introduction (' || length(p_name) || ' chars)', '  (B) 4.2. Results (' || length(p_name) || ' chars)', '  (C) Our Method (' || length(p_name) || ' chars)'][1:n], {_NL}) || CASE WHEN paper % 2 > 0 THEN {_NL} || {_NL} || '  Tables: 1 available' ELSE '' END
  WHEN tool = 'read_section' AND bare THEN 'Error calling read_section: Missing or invalid parameter — ''paper_id'''
  WHEN tool = 'read_section' AND NOT body AND NOT known THEN nope WHEN tool = 'read_section' AND NOT body THEN notext WHEN tool = 'read_section' AND n = 0 THEN none
  WHEN tool = 'read_section' AND n = 1 THEN 'Section ''results'' not found in paper ''' || paper || '''.' || {_NL} || 'Available sections: (A) Introduction' WHEN tool = 'read_section' THEN '=== 4.2. Results ===' || {_NL} || {_NL} || p_name
  WHEN tool = 'think' THEN 'Noted.' WHEN tool = 'submit_answer' AND bare THEN 'Error calling submit_answer: Missing or invalid parameter — ''answer''' WHEN tool = 'submit_answer' THEN 'Answer submitted: B' END AS output FROM b)
SELECT event_id, md5(CASE WHEN over THEN 'REJECTED: ' || tool || ' costs ' || price || ' points, ' || (event_id % 9) || ' left.' ELSE output END) AS output, CASE WHEN over THEN 0 ELSE price END AS cost,
  md5('<tool_result name="' || tool || '">' || {_NL} || 'ok' || {_NL} || '</tool_result>' || {_NL} || '[budget left: ' || event_id || ']') AS envelope, CASE WHEN event_id % 2 = 0 THEN 34 ELSE 56 END AS prompt FROM o"""


def triage_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.slice(F.array(*(F.struct(F.lit(h).alias("header")) for h in ("Introduction", "4.2. Results", "Our Method", "Ablation Study"))), 1, (F.col("p_size") % 5).cast("int"))
    pool = T.table(spark, sf_dir, "part").select(F.concat(F.lit("a"), "p_partkey").alias("arxiv_id"), F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit(" "), F.col("p_partkey") % 30).alias("title"), heads.alias("sections"))
    d = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"), F.min("l_quantity").cast("int").alias("q"))
    d = d.join(pool.select(F.col("pos").alias("p"), "title"), "p").select(F.col("l_orderkey").cast("string").alias("sample"), F.col("l_linenumber").alias("idx"), "p", "flag", "status", "q", "title")
    claims = d.select("sample", "idx", (F.col("flag") != "R").alias("verified"), F.when(F.col("idx") % 3 == 0, F.concat(F.lit(" "), F.upper("title"))).when(F.col("idx") % 3 == 1, F.substring("title", 1, 8)).otherwise("zzz zzz zzz").alias("title"), F.lit("s").alias("section"))
    section = F.element_at(F.array(F.lit("results"), F.lit("Method"), F.lit("Conclusion")), F.col("q") % 3 + 1)
    labels = d.select("sample", "idx", F.when(F.col("status") == "F", "direct").otherwise("supporting").alias("relevance"), F.concat(F.when(F.col("idx") % 2 == 1, "a").otherwise("?"), "p").alias("arxiv_id"), "title", section.alias("section"))
    return triage.triage_cases(claims, labels, pool)


TRIAGE_SQL = """WITH pool AS (SELECT 'a' || p_partkey AS aid, p_partkey AS pos, lower(trim(p_name || ' ' || (p_partkey % 30))) AS t, p_size % 5 AS k FROM part),
names AS (SELECT t, arg_max(aid, pos) AS aid, min(pos) AS pos FROM pool GROUP BY t),
d AS (SELECT l_orderkey::VARCHAR AS sample, l_linenumber AS idx, min(l_partkey) AS p, min(l_returnflag) AS flag, min(l_linestatus) AS status, min(l_quantity)::INT AS q FROM lineitem GROUP BY 1, 2),
e AS (SELECT d.*, p_name || ' ' || (p_partkey % 30) AS title FROM d JOIN part ON p_partkey = p),
c AS (SELECT sample, idx, lower(trim(CASE idx % 3 WHEN 0 THEN ' ' || upper(title) WHEN 1 THEN title[1:8] ELSE 'zzz zzz zzz' END)) AS n FROM e WHERE flag = 'R'),
h AS (SELECT n, arg_min(names.aid, (CASE WHEN t = n THEN 0 ELSE 1 END, pos)) AS aid FROM (SELECT DISTINCT n FROM c) JOIN names ON contains(t, n[1:40]) GROUP BY n),
vf AS (SELECT 0 AS ord, 'vf_' || sample || '_c' || idx AS case_id, 'verified_false' AS type, sample, coalesce(h.aid, '') AS arxiv_id, 's' AS section, coalesce(k, 0) AS n_sections FROM c LEFT JOIN h USING (n) LEFT JOIN pool ON pool.aid = h.aid),
l AS (SELECT sample, idx, CASE WHEN idx % 2 = 1 THEN 'a' || p ELSE coalesce(names.aid, '?' || p) END AS aid, ['results', 'Method', 'Conclusion'][q % 3 + 1] AS section, q % 3 AS s FROM e LEFT JOIN names ON t = lower(trim(title)) WHERE status = 'F')
SELECT * FROM vf UNION ALL SELECT 1, 'us_' || sample || '_l' || idx, 'unresolved_section', sample, aid, section, coalesce(k, 0) FROM l LEFT JOIN pool USING (aid) WHERE coalesce(k, 0) < CASE s WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 9 END"""


def audit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("kind"), F.col("text").alias("seed_text"), F.when(F.col("doc_id") % 2 == 0, F.array("source")).otherwise(F.array().cast("array<string>")).alias("bridges"), F.array("lang", "source").alias("targets"), F.lit("Why?").alias("question"), F.lit("So").alias("answer"))
    return triage.audit_requests(d, "be strict", 3000).select("custom_id", F.md5("prompt").alias("prompt"), "n_chars")


AUDIT_SQL = """WITH p AS (SELECT doc_id::VARCHAR AS custom_id, 'Sample: ' || doc_id || chr(10) || lang || chr(10) || chr(10) || '## Seed paper' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '## Bridge papers' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN source ELSE '[none]' END
  || chr(10) || chr(10) || '## Target papers' || chr(10) || lang || chr(10) || source || chr(10) || chr(10) || '## Question' || chr(10) || 'Why?' || chr(10) || chr(10) || '## Correct answer' || chr(10) || 'So' AS p FROM documents)
SELECT custom_id, md5(p) AS prompt, (length(p) + 9)::INT AS n_chars FROM p WHERE length(p) + 9 <= 3000"""


def multi_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.struct(F.concat(F.lit("paper-of-some-long-id-"), "l_partkey").alias("id"), F.when(F.col("l_partkey") % 7 > 0, "t").alias("title"), (F.col("l_partkey") % 5 > 0).alias("has_text"), (F.col("l_partkey") % 3 == 0).alias("second_step"), (F.col("l_partkey") % 11 == 0).alias("found"))
    d = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(t)).alias("targets"), F.min("l_partkey").alias("p"), F.max("l_linenumber").alias("n"))
    d = d.select("l_orderkey", "targets", F.when(F.col("n") > 1, F.array(F.concat(F.lit("paper-of-some-long-id-"), "p"))).otherwise(F.array().cast("array<string>")).alias("seed_refs"), (F.col("n") % 2 + 1).alias("depth"), F.when(F.col("p") % 2 == 0, F.array(F.lit("k"), F.lit("m"))).otherwise(F.array().cast("array<string>")).alias("keywords"))
    return d.select("l_orderkey", F.array_join(triage.multi_target_checks(), "|").alias("issues"))


MULTI_SQL = """WITH t AS (SELECT DISTINCT l_orderkey, l_partkey, 'paper-of-some-long-id-' || l_partkey AS id FROM lineitem), m AS (SELECT l_orderkey, min(l_partkey) AS p, max(l_linenumber) AS n FROM lineitem GROUP BY 1),
j AS (SELECT t.*, p, n FROM t JOIN m USING (l_orderkey)),
i AS (SELECT l_orderkey, 0 AS o, id, 'TARGET_GHOST: ' || id[1:16] || '...' AS x FROM j WHERE l_partkey % 7 = 0 UNION ALL SELECT l_orderkey, 1, id, 'TARGET_NO_CONTENT: ' || id[1:16] || '...' FROM j WHERE l_partkey % 5 = 0
  UNION ALL SELECT l_orderkey, 2, id, 'TARGET_UNREACHABLE: ' || id[1:16] || '...' FROM j WHERE l_partkey <> p AND n % 2 = 1 AND l_partkey % 3 <> 0
  UNION ALL SELECT l_orderkey, 3, '', 'ANSWER_NOT_IN_TARGETS: 0/2' FROM j WHERE p % 2 = 0 GROUP BY l_orderkey HAVING NOT bool_or(l_partkey % 11 = 0)),
g AS (SELECT l_orderkey, array_to_string(list(x ORDER BY o, id), '|') AS x FROM i GROUP BY 1)
SELECT l_orderkey, CASE WHEN n <= 1 THEN 'SEED_NO_REFS' ELSE coalesce(x, '') END AS issues FROM m LEFT JOIN g USING (l_orderkey)"""


def mode_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes of orders, their guidance from a table, and the prompts around them."""
    o = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "bfs").otherwise("dfs").alias("question_type"))
    kinds = F.array(F.element_at(F.array(*map(F.lit, ("comparison", "evolution", "unclassified"))), (F.col("o_orderkey") % 3 + 1).cast("int")))
    table = spark.createDataFrame([(r, s, q, f"{r} hint", f"{s} rule", f"{q} example") for r in prompts.RELATIONS for s in prompts.SKILLS for q in ("bfs", "dfs")], "relation string, skill string, question_type string, hint string, rule string, example string")
    d = prompts.with_instructions(prompts.modes(o, "o_orderkey", kinds), table)
    path = prompts.path_text(F.array("o_orderpriority", "o_orderstatus"), F.array(F.col("o_custkey").cast("int"), F.lit(None).cast("int")))
    ask = prompts.question_prompt(F.col("instructions"), path, F.array("o_orderstatus"), F.array("o_orderpriority"))
    screen = prompts.screen_prompt(F.col("o_orderpriority"), F.repeat("o_orderstatus", 450), F.array("o_orderstatus", "o_orderpriority"))
    split = prompts.audit_split(F.array(F.struct(F.col("o_orderpriority").alias("section"), F.lit("direct").alias("relevance")), F.struct(F.col("o_orderstatus").alias("section"), F.when(F.col("o_custkey") % 2 == 0, "direct").otherwise("supporting").alias("relevance"))))
    return d.select("o_orderkey", "relation", "skill", F.md5(ask).alias("ask"), F.md5(screen).alias("screen"), F.md5(split).alias("split"))


def _modes_sql() -> str:
    rel = [X.RELATION_OF.get(k, "GROUND") for k in ("comparison", "evolution", "unclassified")]
    u = "('0x' || md5('42|' || o_orderkey)[1:13])::BIGINT / 4503599627370496.0::DOUBLE"
    nl = "chr(10)"
    return f"""WITH o AS (SELECT *, {rel}[o_orderkey % 3 + 1] AS relation, {u} AS u, CASE WHEN o_orderkey % 2 = 0 THEN 'bfs' ELSE 'dfs' END AS q FROM orders),
m AS (SELECT *, CASE WHEN u < 0.3 THEN 'retrieve' WHEN u < 0.55 THEN 'reason' WHEN u < 0.7 THEN 'contrast' WHEN u < 0.8 THEN 'assess' WHEN u < 0.9 THEN 'synthesize' ELSE 'justify' END AS skill FROM o)
SELECT o_orderkey, relation, skill, md5('## Mode' || {nl} || '=== QUESTION MODE: ' || relation || ' × ' || skill || ' ===' || {nl} || 'Relation: ' || relation || ' hint' || {nl} || 'Skill: ' || skill || ' rule' || {nl} || q || ' example' || {nl} || {nl}
  || '## Path' || {nl} || '1. ' || o_orderpriority || ' (' || o_custkey || ')' || {nl} || '2. ' || o_orderstatus || ' (?)' || {nl} || {nl} || '## Papers' || {nl} || o_orderstatus || {nl} || {nl} || '## Contexts' || {nl} || '  [1] "' || o_orderpriority || '"') AS ask,
  md5('Paper: ' || o_orderpriority || {nl} || 'Abstract: ' || repeat(o_orderstatus, 400) || '...' || {nl} || 'Cited as:' || {nl} || '  [1] "' || o_orderstatus || '"' || {nl} || '  [2] "' || o_orderpriority || '"' || {nl} || 'Score the citation from 1 to 5.') AS screen,
  md5('Direct:' || {nl} || '- ' || o_orderpriority || CASE WHEN o_custkey % 2 = 0 THEN {nl} || '- ' || o_orderstatus || {nl} || 'Supporting:' ELSE {nl} || 'Supporting:' || {nl} || '- ' || o_orderstatus END) AS split FROM m"""


def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, tables as text, headers that a claim names, and settings of a run."""
    c = T.table(spark, sf_dir, "customer")
    t = F.concat("c_name", F.lit("\n \n"), F.lit("  "), F.col("c_mktsegment"), F.lit("\n\n\n\n"), F.lit("end "))
    table = X.table_text(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.col("c_custkey").cast("string"), F.lit("2"))))
    claim = X.claimed(F.element_at(F.array(F.lit(""), F.lit("4.2. Results"), F.lit("Method")), (F.col("c_custkey") % 3 + 1).cast("int")), F.element_at(F.array(F.lit(""), F.lit("results")), (F.col("c_custkey") % 2 + 1).cast("int")))
    return c.select("c_custkey", F.array_join(X.paragraphs(t), "|").alias("paragraphs"), F.md5(table).alias("table"), claim.alias("claimed"))


def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.table(spark, sf_dir, "nation")
    given = n.where("n_nationkey % 5 = 0").select(F.lower("n_name").alias("key"), F.lit("given").alias("value"))
    preset = n.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("key"), F.lit("preset").alias("value"))
    known = [f"nation_{i}" for i in range(20)]
    return prompts.presets(given, preset, {k: "default" for k in known}, known)


QUERIES = {
    "evaluation_report": (evaluation_report, REPORT_SQL),
    "retry_lists": (retry_lists, RETRY_SQL),
    "filter_report": (filter_report, FILTER_SQL),
    "chain_stats": (chain_stats, STATS_SQL),
    "counters": (counters, f"WITH {T.RUNS_SQL} SELECT question_type || ':' || terminated_by AS key, count(*) AS n FROM runs GROUP BY 1 UNION ALL SELECT 'tier:' || coalesce(tier, 'none'), count(*) FROM runs GROUP BY 1 UNION ALL SELECT 'venue:' || venue, count(*) FROM runs GROUP BY 1"),
    "role_means": (role_means, "SELECT p_type, count(*) AS n, round(avg(p_size), 1) AS mean_p_size, round(avg(p_partkey), 1) AS mean_p_partkey FROM part GROUP BY 1"),
    "slim_ratio": (slim_ratio, "SELECT count(*) AS n, count_if(doc_id % 4 > 0 AND coalesce(text, '') <> '') AS have, round(count_if(doc_id % 4 > 0 AND coalesce(text, '') <> '') / count(*), 4) AS share, round(sum(strlen(text)) / sum(strlen(text[1:40])), 2) AS ratio FROM documents"),
    "tier_seeds": (tier_seeds, TIER_SQL),
    "search_bulk": (search_bulk, "SELECT 'p' || o_custkey AS \"paperId\", o_orderkey AS pos, year(o_orderdate)::INT AS year, o_orderkey * 7 % 1000 AS \"citationCount\" FROM orders WHERE o_orderpriority = '2-HIGH' AND year(o_orderdate) BETWEEN 1994 AND 1997 AND o_orderkey * 7 % 1000 >= 300 ORDER BY pos LIMIT 200"),
    "narrowing_fields": (narrowing_fields, NARROW_SQL),
    "page_fetch": (page_fetch, "SELECT page_id, CASE WHEN page_id % 3 > 0 AND length(html) > 1000 THEN length(html) WHEN length(html) + length(url) > 1000 THEN length(html) + length(url) END AS n_chars FROM pages"),
    "paper_fields": (paper_fields, "SELECT p.p_partkey, CASE WHEN p.p_partkey % 3 = 0 THEN 'a' || p.p_partkey WHEN p.p_partkey % 2 = 0 THEN 'o' || p.p_partkey ELSE '' END AS arxiv, CASE p.p_type WHEN 'ECONOMY' THEN 'ECO' WHEN 'SMALL' THEN 'S' ELSE p.p_type END AS venue, CASE WHEN q.p_partkey IS NOT NULL THEN p.p_size END AS p_size FROM part p LEFT JOIN part q ON q.p_partkey + 3 = p.p_partkey"),
    "abstract_backfill": (abstract_backfill, "WITH l AS (SELECT l_orderkey, l_partkey, CASE WHEN min(l_quantity) > 10 THEN min(l_returnflag) END AS a FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_partkey, coalesce(a, CASE WHEN p_partkey % 4 > 0 THEN p_name END) AS abstract FROM l LEFT JOIN part ON p_partkey = l_partkey"),
    "siblings": (siblings, "WITH c AS (SELECT 'S' || l_suppkey AS seed, 'P' || l_partkey AS terminal, l_orderkey * 10 + l_linenumber AS pos, min(l_returnflag) AS title FROM lineitem WHERE l_partkey % 10 > 0 GROUP BY 1, 2, 3) SELECT seed, terminal, arg_min(title, pos) AS title FROM c GROUP BY 1, 2"),
    "chain_views": (chain_views, VIEWS_SQL),
    "gold_ids": (gold_ids, GOLD_SQL),
    "distractor_contexts": (distractor_contexts, CONTEXTS_SQL),
    "loaders": (loaders, "WITH e AS (SELECT user_id AS id, event_id AS pos, event_type AS question, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k')::INT END AS k FROM events WHERE user_id % 9 > 0 AND event_type <> 'error') SELECT id, max(pos) AS pos, arg_max(question, pos) AS question, max_by({'k': k}, pos).k AS k FROM e GROUP BY id"),
    "cache_and_batch": (cache_and_batch, "SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus ELSE 'none' END AS reply, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer LEFT JOIN orders ON o_orderkey = c_custkey GROUP BY 1"),
    "kill_switch": (kill_switch, "WITH r AS (SELECT o_orderkey AS pos, coalesce(sum(o_custkey % 1000) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 1000000 AS run FROM orders) SELECT run, count(*) AS n, max(pos) AS last FROM r GROUP BY 1"),
    "deep_siblings": (deep_siblings, DEEP_SQL),
    "titles_in_scope": (titles_in_scope, SCOPE_SQL),
    "tool_messages": (tool_messages, MESSAGES_SQL),
    "triage_cases": (triage_cases, TRIAGE_SQL),
    "audit_requests": (audit_requests, AUDIT_SQL),
    "multi_sanity": (multi_sanity, MULTI_SQL),
    "mode_prompts": (mode_prompts, _modes_sql()),
    "text_parts": (text_parts, f"""SELECT c_custkey, c_name || '|' || c_mktsegment || '|end' AS paragraphs, md5('Table: ' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END || chr(10) || '| a | b |' || chr(10) || '| ' || c_custkey || ' | 2 |') AS "table", CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 = 0 ELSE c_custkey % 3 = 1 END AS claimed FROM customer"""),
    "run_settings": (run_settings, "WITH d AS (SELECT 'nation_' || i AS key, 'default' AS v, 2 AS o FROM range(20) t(i) UNION ALL SELECT lower(n_name), 'preset', 1 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT lower(n_name), 'given', 0 FROM nation WHERE n_nationkey % 5 = 0) SELECT key, arg_min(v, o) AS value, key NOT IN (SELECT 'nation_' || i FROM range(20) t(i)) AS unknown FROM d GROUP BY key"),
}
