"""Queries of joins, graphs, windows, ensembles and audits, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.operators import audit, ensemble, graph, joins, report, sampling, search, validate
from quillgraph.functions import sections as S
from quillgraph.plans import tables as T


def edge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier-part pair as a reference: a context per line, influential if any was returned."""
    d = T.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("inf"), F.collect_list(F.repeat(F.lit("c"), F.col("l_quantity").cast("int") * 5)).alias("ctx"),
        F.when(F.bool_or(F.col("l_linestatus") == "F"), F.array(F.lit("methodology"))).otherwise(F.array(F.lit("result"))).alias("intents"),
    )
    return d.select("l_suppkey", "l_partkey", graph.edge_score(F.col("inf"), F.col("ctx"), F.col("intents")).alias("score"))


SCORE_SQL = """WITH d AS (SELECT l_suppkey, l_partkey, bool_or(l_returnflag = 'R') AS inf, count(*) AS n, count_if(l_quantity::INT * 5 >= 80) AS s, avg(l_quantity::INT * 5) FILTER (WHERE l_quantity::INT * 5 >= 80) AS m, bool_or(l_linestatus = 'F') AS f FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_partkey, (inf::INT * 10 + s * 2 + n * 0.5 + CASE WHEN f THEN 5 ELSE 3 END + CASE WHEN m > 200 THEN 2 WHEN m > 120 THEN 1 ELSE 0 END)::DOUBLE AS score FROM d"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst")).agg((F.count("*") * 2.5 + F.max(F.when(F.col("l_returnflag") == "R", 10.0).otherwise(0.0)) - 2.5).alias("score"), F.sum("l_quantity").alias("cited"))
    return d.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("dst")))


SCORED_SQL = """g AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, count(*) * 2.5 + max(CASE WHEN l_returnflag = 'R' THEN 10 ELSE 0 END) - 2.5 AS score, sum(l_quantity) AS cited FROM lineitem GROUP BY 1, 2),
sc AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos FROM g)"""


def top_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_references(_scored(spark, sf_dir), 10).select("src", "dst", "rank", "score")


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("seed"))


def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.two_hop(T.edges(spark, sf_dir), _seeds(spark, sf_dir), 30)


def bridge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _seeds(spark, sf_dir).withColumn("terminal", F.concat(F.lit("S"), F.substring("seed", 2, 9).cast("int") + 1))
    return graph.bridges(T.edges(spark, sf_dir), pairs, T.tasks(T.table(spark, sf_dir, "lineitem")))


def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = T.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("seed"), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "S").otherwise("P"), F.col("s_suppkey") * 3).alias("target"))
    return graph.reachable(T.edges(spark, sf_dir), pairs)


def reference_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = T.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("a"), F.concat(F.lit("S"), F.col("s_suppkey") + 1).alias("b"))
    return graph.reference_jaccard(T.edges(spark, sf_dir, "S"), pairs, T.tasks(T.table(spark, sf_dir, "lineitem")))


def greedy_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and the parts of their lines refer to each other; lines are dealt by source once, both ways."""
    d = T.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_returnflag") == "R").alias("r"), "l_quantity")
    n = T.tasks(d, 125_000)
    s, p = F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("P"), "l_partkey")
    ends = F.explode(F.array(F.struct(s.alias("src"), p.alias("dst")), F.struct(p.alias("src"), s.alias("dst"))))
    g = d.select(ends.alias("e"), "r", "l_quantity").select("e.src", "e.dst", "r", "l_quantity").repartition(n, "src").groupBy("src", "dst")
    g = g.agg((F.count("*") * 2.5 + F.max(F.when(F.col("r"), 10.0).otherwise(0.0)) - 2.5).alias("score"), F.sum("l_quantity").alias("cited"))
    g = g.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
    out = graph.expand_greedily(g, _seeds(spark, sf_dir), tasks=n)
    return out.select("seed", "depth", "rank", "parent", "node", "score", F.array_join("path", ">").alias("path"))


_NODE, _PICK = "STRUCT(node VARCHAR, path VARCHAR[])[]", "STRUCT(node VARCHAR, score DOUBLE, path VARCHAR[])[]"
GREEDY_SQL = f"""WITH RECURSIVE {SCORED_SQL}, ed AS (SELECT src, dst, pos, score, cited FROM sc UNION ALL SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src), score, cited FROM sc),
c AS MATERIALIZED (SELECT src, list({{'dst': dst, 'score': score::DOUBLE}} ORDER BY score DESC, pos) FILTER (score >= 3) AS strong,
  list({{'dst': dst, 'score': least(cited / 100.0, 50.0)::DOUBLE}} ORDER BY least(cited / 100.0, 50.0) DESC, pos) AS weak FROM ed GROUP BY src),
t AS (
  SELECT 'S' || s_suppkey AS seed, 1 AS level, 1 AS i, [{{'node': 'S' || s_suppkey, 'path': ['S' || s_suppkey]}}]::{_NODE} AS cur, []::{_NODE} AS nxt, ['S' || s_suppkey] AS seen,
    0 AS did, 0::BIGINT AS ranked, NULL::VARCHAR AS parent, []::{_PICK} AS picked FROM supplier
  UNION ALL
  SELECT seed, CASE WHEN i < len(cur) THEN level ELSE level + 1 END, CASE WHEN i < len(cur) THEN i + 1 ELSE 1 END, CASE WHEN i < len(cur) THEN cur ELSE more END, CASE WHEN i < len(cur) THEN more ELSE [] END,
    seen || list_transform(p, lambda x: x.node), level, len(nxt), par, p
  FROM (SELECT *, nxt || list_transform(p, lambda x: {{'node': x.node, 'path': x.path}}) AS more
    FROM (SELECT *, list_transform(list_slice(CASE WHEN len(good) > 0 THEN good ELSE list_filter(others, lambda x: NOT list_contains(seen, x.dst)) END, 1, [10, 7][level]), lambda x: {{'node': x.dst, 'score': x.score, 'path': pp || [x.dst]}}) AS p
      FROM (SELECT q.*, q.cur[q.i].node AS par, q.cur[q.i].path AS pp, coalesce(c.weak, []) AS others, list_filter(coalesce(c.strong, []), lambda x: NOT list_contains(q.seen, x.dst)) AS good
        FROM (SELECT seed, level, i, cur, nxt, seen FROM t WHERE level <= 2 AND i <= len(cur)) q LEFT JOIN c ON c.src = q.cur[q.i].node) x) y) z
), o AS (SELECT seed, did AS depth, ranked, parent, unnest(picked) AS x, unnest(range(len(picked))) AS k FROM t WHERE did > 0)
SELECT seed, depth, (ranked + k + 1)::INT AS rank, parent, x.node AS node, x.score AS score, array_to_string(x.path, '>') AS path FROM o"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = T.table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("title"))
    return graph.neighbours(T.edges(spark, sf_dir), nodes).select("src", "n", F.md5("listing").alias("listing"))


def sibling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seed"), F.concat(F.lit("P"), "l_partkey").alias("terminal"), F.array(F.concat("l_returnflag", F.year("l_shipdate")), "l_linestatus").alias("contexts"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity").alias("o"))
    d = d.withColumn("pos", F.row_number().over(Window.partitionBy("seed").orderBy("o")))
    return graph.sibling_pairs(d).select("seed", "pos1", "pos2", "t1", "t2", F.array_join("shared", "|").alias("shared"))


SIBLING_SQL = """WITH d AS (SELECT l_orderkey AS seed, 'P' || l_partkey AS terminal, [l_returnflag || year(l_shipdate), l_linestatus] AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS pos FROM lineitem)
SELECT a.seed, a.pos AS pos1, b.pos AS pos2, a.terminal AS t1, b.terminal AS t2, array_to_string(list_sort(list_intersect(a.c, b.c))[1:2], '|') AS shared FROM d a JOIN d b ON a.seed = b.seed AND a.pos < b.pos AND a.terminal <> b.terminal"""


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), 0))
    q = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), tok(F.col("text")).alias("tokens"))
    d = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("pos"), tok(F.col("text")).alias("tokens"))
    return search.token_overlap_search(q, d, 5).select("qid", "doc", "overlap", "rank")


SEARCH_SQL = r"""WITH q AS (SELECT item_id AS qid, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS w FROM benchmark),
d AS (SELECT doc_id AS doc, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS w FROM documents),
h AS (SELECT qid, doc, count(*) AS overlap FROM q JOIN d USING (w) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, doc) AS rank FROM h)
SELECT * FROM r WHERE rank <= 5"""


def first_match_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.split("text", "\n")[0]
    t = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tid"), F.col("doc_id").alias("pos"), line.alias("title"))
    q = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 2 == 0, F.lower(F.substring(line, 1, 30))).otherwise(F.concat(F.lit(" "), line)).alias("title"))
    return joins.first_title(q, t).select("qid", "tid", "rank")


TITLE_SQL = """WITH t AS (SELECT doc_id AS tid, lower(trim(string_split(text, chr(10))[1])) AS t FROM documents),
q AS (SELECT doc_id AS qid, lower(trim(CASE WHEN doc_id % 2 = 0 THEN lower(string_split(text, chr(10))[1][1:30]) ELSE ' ' || string_split(text, chr(10))[1] END)) AS q FROM documents),
e AS (SELECT qid, min(tid) AS tid FROM q JOIN t ON q = t WHERE q <> '' GROUP BY 1), p AS (SELECT qid, min(tid) AS tid FROM q JOIN t ON contains(t, q[1:40]) WHERE q <> '' AND qid NOT IN (SELECT qid FROM e) GROUP BY 1)
SELECT q.qid, coalesce(e.tid, p.tid) AS tid, CASE WHEN e.tid IS NOT NULL THEN 0 WHEN p.tid IS NOT NULL THEN 1 END AS rank FROM q LEFT JOIN e USING (qid) LEFT JOIN p USING (qid)"""

_DIMS = [(0, "small"), (1, "s"), (2, "small r"), (3, "red"), (4, "re"), (5, "blue widget"), (6, "b")]


def prefix_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame(_DIMS, "ord int, prefix string")
    return joins.prefix_join(T.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", dim).select("p_partkey", "prefix", "ord")


def priority_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's abstract: its benchmark item, else its second line, else its first of 100 characters."""
    d = T.table(spark, sf_dir, "documents")
    b = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("abstract"))
    part = lambda i: d.select("doc_id", F.get(F.split("text", "\n"), F.lit(i)).alias("abstract"))
    ok = lambda n: F.length("abstract") >= n
    return joins.first_source(d.select("doc_id"), "doc_id", "abstract", [(b, ok(50)), (part(1), ok(50)), (part(0), ok(100))]).select("doc_id", "prio", F.length("abstract").alias("n"))


PRIORITY_SQL = """WITH a AS (SELECT d.doc_id, b.text AS b, string_split(d.text, chr(10))[2] AS l2, string_split(d.text, chr(10))[1] AS l1 FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id)
SELECT doc_id, CASE WHEN length(b) >= 50 THEN 0 WHEN length(l2) >= 50 THEN 1 WHEN length(l1) >= 100 THEN 2 END AS prio, CASE WHEN length(b) >= 50 THEN length(b) WHEN length(l2) >= 50 THEN length(l2) WHEN length(l1) >= 100 THEN length(l1) END AS n FROM a"""


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return joins.keep_first(d, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], last=True).select("user_id", "event_type", "event_id")


def one_per_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sampling.one_per_key(d, "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")])


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return sampling.round_robin(d, "o_orderpriority", [F.col("cents").desc(), F.col("o_orderkey")], 400)


def venue_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "orders").join(T.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return sampling.stratified_quota(d, "c_mktsegment", [F.col("cents").desc(), F.col("o_orderkey")], 303, 5).select("o_orderkey", "c_mktsegment")


def slice_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters before the limit, rows in order."""
    return T.qa(spark, sf_dir).where("lang = 'fr'").where("n_chars > 500").orderBy("doc_id").limit(50).select("doc_id", "n_chars")


def metadata_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with at least half of their lines discounted (a reference with a context)."""
    d = T.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg((F.col("l_discount") > 0.04).cast("int")).alias("coverage"))
    return d.where("coverage >= 0.5").select("l_suppkey", F.round("coverage", 6).alias("coverage"))


def vote_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ensemble.gates(T.votes(spark, sf_dir), b=1)
    return d.select("qid", "votes", "right", "a_passed", "sufficient", "c_right", "c_passed", ensemble.tier(F.col("right"), F.col("c_right"), F.col("a_passed")).alias("tier"))


GATES_SQL = f"""WITH {T.VOTES_SQL},
p AS (SELECT qid, paper, count_if(answer = truth) AS r FROM votes GROUP BY 1, 2), b AS (SELECT qid, bool_or(r >= 1) AS sufficient FROM p GROUP BY 1),
v AS (SELECT qid, count(*) AS votes, count_if(answer = truth) AS "right", count(DISTINCT paper) AS papers FROM votes GROUP BY 1),
x AS (SELECT v.*, sufficient, "right" < 2 AS a_passed, CASE WHEN papers < 2 THEN votes ELSE "right" END AS c_right, papers < 2 OR "right" >= 2 AS c_passed FROM v JOIN b USING (qid))
SELECT qid, votes, "right", a_passed, sufficient, c_right, c_passed, CASE WHEN NOT a_passed THEN 'rejected' WHEN "right" = 0 AND c_right = 3 THEN 'gold' WHEN "right" <> 0 AND c_right = 3 THEN 'silver' ELSE 'bronze' END AS tier FROM x"""


def gate_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ensemble.right_votes(T.votes(spark, sf_dir)).join(T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), "o_orderstatus"), "qid")
    d = v.withColumns({"a": F.col("right") < 2, "c": F.col("right") >= 2})
    return d.cube("o_orderstatus").agg(F.count("*").alias("n"), F.count_if("a").alias("a"), F.count_if("c").alias("c"), F.count_if(F.col("a") & F.col("c")).alias("both"), F.sum("right").alias("right_votes"))


def sanity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.concat(F.lit("P"), F.col("o_orderkey") % 50)).alias("terminal"), F.concat(F.lit("P"), F.col("o_custkey") % 50).alias("seed"),
        (F.col("o_orderkey") % 2 + 1).cast("int").alias("depth"), F.when(F.col("o_custkey") % 3 == 0, F.lit("B")).alias("bridge"), (F.col("o_orderkey") % 4).cast("int").alias("terminal_sections"),
        (F.col("o_custkey") % 5).cast("int").alias("seed_sections"), (F.col("o_orderkey") % 6).cast("int").alias("keywords_found"), F.sequence(F.lit(1), F.when(F.col("o_custkey") % 10 == 0, 3).otherwise(4)).alias("options"),
    )
    return o.select("o_orderkey", F.array_join(validate.issues(validate.single_target_checks(), fatal=2), "|").alias("issues"))


SANITY_SQL = """WITH d AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 13 = 0 THEN 'MISSING_TERMINAL' ELSE array_to_string(list_filter([CASE WHEN k % 50 = c % 50 THEN 'SELF_REFERENCE' END, CASE WHEN k % 2 = 1 AND c % 3 <> 0 THEN 'NO_BRIDGE_PATH' END, CASE WHEN k % 4 = 0 THEN 'TERMINAL_NO_CONTENT' END,
  CASE WHEN c % 5 = 0 THEN 'SEED_NO_CONTENT' END, CASE WHEN c % 10 = 0 THEN 'BAD_OPTIONS' END, CASE WHEN k % 6 = 0 THEN 'WARN_NO_KEYWORDS' END], lambda x: x IS NOT NULL), '|') END AS issues FROM d"""


def issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issue_histogram(sanity_flags(spark, sf_dir).select(F.filter(F.split("issues", r"\|"), lambda x: x != "").alias("issues")))


def verdict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("sample"), F.lit("vf").alias("kind"), F.col("l_linenumber").alias("idx")).agg(F.min("l_returnflag").alias("section"), F.min("l_linestatus").alias("relevance"))
    o = T.table(spark, sf_dir, "orders")
    v = o.select(F.concat(F.lit("vf_"), "o_orderkey", F.lit("_c"), F.col("o_custkey") % 7).alias("case_id"), F.element_at(F.array(F.lit("drop_sample"), F.lit("drop"), F.lit("repoint"), F.lit("demote")), (F.col("o_custkey") % 4 + 1).cast("int")).alias("verdict"), F.lit("X").alias("repoint_to"))
    return audit.apply_verdicts(claims, audit.case_parts(v))


VERDICT_SQL = """WITH c AS (SELECT l_orderkey AS k, l_orderkey::VARCHAR AS sample, 'vf' AS kind, l_linenumber AS idx, min(l_returnflag) AS section, min(l_linestatus) AS relevance FROM lineitem GROUP BY 1, 4),
v AS (SELECT o_orderkey AS k, (o_custkey % 7)::INT AS idx, o_custkey % 4 AS v FROM orders)
SELECT c.sample, kind, c.idx, CASE WHEN o.v = 2 THEN 'X' ELSE section END AS section, CASE WHEN o.v = 2 THEN section END AS repointed_from, CASE WHEN o.v = 3 THEN 'supporting' ELSE relevance END AS relevance, CASE WHEN o.v = 3 THEN relevance END AS demoted_from
FROM c LEFT JOIN v o ON c.k = o.k AND c.idx = o.idx AND o.v > 0 WHERE c.k NOT IN (SELECT k FROM v WHERE v = 0) AND coalesce(o.v, 9) <> 1"""


def oversize_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.lines(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "header", "body"))), lambda x: F.struct(x["header"].alias("header"), x["body"].alias("text"))).alias("s"))
    gold_bad = d.where("doc_id % 2 = 0").where(S.oversized(F.col("s"), 900))
    return validate.drop_flagged(d, gold_bad, "doc_id").select("doc_id", F.size(S.without_oversized(F.col("s"), 900)).alias("sections"))


def pool_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers without their oversized lines, but for gold ones (those that a label marks as good)."""
    d = T.lines(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "header", "body"))), lambda x: F.struct(x["header"].alias("header"), x["body"].alias("text"))).alias("s"))
    gold = T.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("gold", F.lit(True))
    s = S.without_oversized(F.col("s"), 900, F.col("gold"))
    chars = F.aggregate(s, F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"]))
    return d.join(gold, "doc_id", "left").select("doc_id", F.size(s).alias("sections"), (F.size("s") - F.size(s)).alias("stripped"), chars.alias("chars"))


STRIP_SQL = f"""WITH {T.LINES_SQL}, g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), k AS (SELECT lines.*, g.doc_id IS NOT NULL OR length(body) <= 900 AS stays FROM lines LEFT JOIN g ON lines.doc_id = g.doc_id)
SELECT doc_id, count_if(stays) AS sections, count_if(NOT stays) AS stripped, coalesce(sum(length(body)) FILTER (stays), 0)::BIGINT AS chars FROM k GROUP BY doc_id"""


def audit_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.progress(T.table(spark, sf_dir, "documents"), T.table(spark, sf_dir, "labels"), "doc_id", "doc_id")


def review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = T.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")  # noqa: E741
    d = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    src = [l.where("toxic = 1").withColumn("reason", F.lit("toxic")), l.where("quality = 0").withColumn("reason", F.lit("low quality")), d.where("n_chars > 5000").withColumn("reason", F.lit("long"))]
    return audit.merge_reasons(src).select("id", F.array_join("reasons", "|").alias("reasons"), "sources")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that pass one gate, another, both or one only; and those done that a list excludes."""
    d, l = T.table(spark, sf_dir, "documents").select("doc_id"), T.table(spark, sf_dir, "labels")  # noqa: E741
    a, b = l.where("quality = 1").select("doc_id"), l.where("toxic = 0").select("doc_id")
    parts = {"both": a.intersect(b), "a_only": a.subtract(b), "either": a.union(b).distinct(), "unlabelled": d.join(l, "doc_id", "left_anti"), "excluded": d.join(a.union(b).distinct(), "doc_id", "left_anti")}
    out = None
    for name, x in parts.items():
        one = x.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark text. Candidates have the text's longest inner word; only
    texts of less than three words are looked for in every document."""
    b = T.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    b = b.withColumn("w", F.expr(r"regexp_extract_all(item, '[^\\s]+', 0)")).withColumn("n", F.size("w"))
    inner = F.transform(F.expr("slice(w, 2, n - 2)"), lambda x: F.struct(F.length(x).alias("l"), x.alias("x")))
    long = b.where("n > 2").withColumn("word", F.array_max(inner)["x"]).drop("w", "n")
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    words = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\s]+"), 0))).alias("word"))
    pairs = words.join(long.select("item_id", "word"), "word").select("doc_id", "item_id")
    near = d.join(pairs, "doc_id").join(long.select("item_id", "item"), "item_id")
    short = d.join(b.where("n <= 2").select("item_id", "item"), F.contains("text", F.col("item")))
    return near.where(F.contains("text", F.col("item"))).select("doc_id", "item_id").unionByName(short.select("doc_id", "item_id")).distinct()


QUERIES = {
    "edge_score": (edge_score, SCORE_SQL),
    "top_references": (top_references, f"WITH {SCORED_SQL}, r AS (SELECT src, dst, score::DOUBLE AS score, row_number() OVER (PARTITION BY src ORDER BY score DESC, pos) AS rank FROM sc) SELECT * FROM r WHERE rank <= 10"),
    "two_hop": (two_hop, f"WITH {T.EDGES_SQL}, s AS (SELECT 'S' || s_suppkey AS seed FROM supplier) SELECT seed, a.dst AS mid, b.dst AS node FROM s JOIN edges a ON a.src = seed AND a.pos <= 30 JOIN edges b ON b.src = a.dst AND b.pos <= 30 WHERE b.dst <> seed"),
    "bridge_path": (bridge_path, f"WITH {T.EDGES_SQL}, s AS (SELECT 'S' || s_suppkey AS seed, 'S' || (s_suppkey + 1) AS terminal FROM supplier) SELECT seed, terminal, arg_min(a.dst, a.pos) AS bridge FROM s JOIN edges a ON a.src = seed JOIN edges b ON b.src = a.dst AND b.dst = terminal GROUP BY 1, 2"),
    "reachable": (reachable, f"WITH {T.EDGES_SQL}, s AS (SELECT 'S' || s_suppkey AS seed, CASE WHEN s_suppkey % 2 = 0 THEN 'S' ELSE 'P' END || (s_suppkey * 3) AS target FROM supplier) SELECT seed, target, EXISTS (SELECT 1 FROM edges a WHERE a.src = seed AND a.dst = target) OR EXISTS (SELECT 1 FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src = seed AND b.dst = target) AS reachable FROM s"),
    "reference_jaccard": (reference_jaccard, f"WITH {T.EDGES_SQL}, n AS (SELECT src, count(*) AS n FROM edges GROUP BY 1), p AS (SELECT 'S' || s_suppkey AS a, 'S' || (s_suppkey + 1) AS b FROM supplier), h AS (SELECT a, b, count(*) AS shared FROM p JOIN edges x ON x.src = a JOIN edges y ON y.src = b AND y.dst = x.dst GROUP BY 1, 2) SELECT p.a, p.b, coalesce(shared, 0) AS shared, round(coalesce(shared / nullif(coalesce(na.n, 0) + coalesce(nb.n, 0) - coalesce(shared, 0), 0), 0), 4) AS jaccard FROM p LEFT JOIN h USING (a, b) LEFT JOIN n na ON na.src = p.a LEFT JOIN n nb ON nb.src = p.b"),
    "greedy_expand": (greedy_expand, GREEDY_SQL),
    "neighbours": (neighbours, f"WITH {T.EDGES_SQL} SELECT src, count(*) AS n, md5(array_to_string(list(pos || '. ' || CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE '?' END ORDER BY pos), chr(10))) AS listing FROM edges LEFT JOIN part ON 'P' || p_partkey = dst GROUP BY src".replace("CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE '?' END", "CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE '?' END")),
    "sibling_pairs": (sibling_pairs, SIBLING_SQL),
    "keyword_search": (keyword_search, SEARCH_SQL),
    "first_match_title": (first_match_title, TITLE_SQL),
    "prefix_longest": (prefix_longest, "WITH d(ord, prefix) AS (VALUES " + ", ".join(f"({o}, '{p}')" for o, p in _DIMS) + "), m AS (SELECT p_partkey, arg_max(prefix, length(prefix)) AS prefix, arg_max(ord, length(prefix)) AS ord FROM part JOIN d ON starts_with(p_name, prefix) GROUP BY 1) SELECT part.p_partkey, prefix, ord FROM part LEFT JOIN m USING (p_partkey)"),
    "priority_coalesce": (priority_coalesce, PRIORITY_SQL),
    "last_wins": (last_wins, "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2"),
    "one_per_seed": (one_per_seed, "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1"),
    "round_robin": (round_robin, "WITH t AS (SELECT o_orderpriority, o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY cents DESC, o_orderkey) AS turn FROM t) SELECT * FROM r ORDER BY turn, cents DESC, o_orderkey LIMIT 400"),
    "venue_quota": (venue_quota, "WITH t AS (SELECT o_orderkey, c_mktsegment, round(o_totalprice * 100)::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY cents DESC, o_orderkey) > 60 AS f FROM t) SELECT o_orderkey, c_mktsegment FROM r ORDER BY f, cents DESC, o_orderkey LIMIT 303"),
    "slice_filter": (slice_filter, "SELECT doc_id, n_chars FROM documents WHERE lang = 'fr' AND n_chars > 500 ORDER BY doc_id LIMIT 50"),
    "metadata_coverage": (metadata_coverage, "SELECT l_suppkey, round(avg((l_discount > 0.04)::INT), 6) AS coverage FROM lineitem GROUP BY 1 HAVING avg((l_discount > 0.04)::INT) >= 0.5"),
    "vote_gates": (vote_gates, GATES_SQL),
    "gate_crosstab": (gate_crosstab, f"WITH {T.VOTES_SQL}, v AS (SELECT qid, o_orderstatus, count_if(answer = truth) AS r FROM votes JOIN orders ON qid = o_orderkey GROUP BY 1, 2) SELECT o_orderstatus, count(*) AS n, count_if(r < 2) AS a, count_if(r >= 2) AS c, 0::BIGINT AS both, sum(r)::BIGINT AS right_votes FROM v GROUP BY CUBE (o_orderstatus)"),
    "sanity_flags": (sanity_flags, SANITY_SQL),
    "issue_histogram": (issue_histogram, f"WITH s AS ({SANITY_SQL}) SELECT x AS issue, count(*) AS n FROM (SELECT unnest(string_split(issues, '|')) AS x FROM s) WHERE x <> '' GROUP BY 1"),
    "verdict_merge": (verdict_merge, VERDICT_SQL),
    "pool_strip": (pool_strip, STRIP_SQL),
    "oversize_drop": (oversize_drop, f"WITH {T.LINES_SQL} SELECT doc_id, count_if(length(body) <= 900) AS sections FROM lines GROUP BY doc_id HAVING NOT (doc_id % 2 = 0 AND bool_or(length(body) > 900))"),
    "audit_progress": (audit_progress, "SELECT count(*) AS total, count(l.doc_id) AS done, count(*) - count(l.doc_id) AS remaining, min(d.doc_id) FILTER (WHERE l.doc_id IS NULL) AS first_open FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id"),
    "review_merge": (review_merge, "WITH u AS (SELECT doc_id AS id, 0 AS o, 'toxic' AS r FROM labels WHERE toxic = 1 UNION SELECT doc_id, 1, 'low quality' FROM labels WHERE quality = 0 UNION SELECT doc_id, 2, 'long' FROM documents WHERE n_chars > 5000) SELECT id, array_to_string(list(r ORDER BY o), '|') AS reasons, count(DISTINCT o) AS sources FROM u GROUP BY id"),
    "set_operations": (set_operations, """WITH a AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), b AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0), u AS (SELECT * FROM a UNION SELECT * FROM b)
SELECT 'both' AS part, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'a_only', count(*), sum(doc_id)::BIGINT FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', count(*), sum(doc_id)::BIGINT FROM u
UNION ALL SELECT 'unlabelled', count(*), sum(doc_id)::BIGINT FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'excluded', count(*), sum(doc_id)::BIGINT FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM u)"""),
    "contamination": (contamination, "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"),
}
