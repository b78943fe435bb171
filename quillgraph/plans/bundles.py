"""Queries of bundles, claims, replies, model calls and numbered rows, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import replies as R
from quillgraph.operators import audit, bundle, construction, graph, replay, report
from quillgraph.plans import tables as T
from quillgraph.plans.texts import sql_norm
from quillgraph.sources import files


LOW = "abcdefghijklmnopqrstuvwxyz"


def claim_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents in a row are the papers of a sample and their lines its sections; each line is a claim too, under
    its header in other letters, with a number, in reverse, under an end of its text, or under an unknown name."""
    d = T.lines(spark, sf_dir).withColumns({"sample": F.floor(F.col("doc_id") / 3), "at": F.col("doc_id") * 100_000 + F.col("pos")})
    asked = F.when(F.col("pos") % 5 == 0, F.translate("header", LOW, LOW.upper())).when(F.col("pos") % 5 == 1, F.concat(F.lit("4.2. "), "header")).when(F.col("pos") % 5 == 2, F.array_join(F.reverse(F.split("header", " ")), " "))
    asked = asked.when(F.col("pos") % 5 == 3, F.expr("right(body, 12)")).otherwise("no such section")
    claim = F.when(F.col("doc_id") % 2 == 0, F.col("body")).otherwise(F.concat(F.col("header"), F.lit(" 12.5% "), F.col("pos").cast("string")))
    return bundle.verify_claims(d.select("sample", F.col("at").alias("claim_id"), claim.alias("claim"), asked.alias("source_section")), d.select("sample", F.col("at").alias("pos"), "header", F.col("body").alias("text")))


def claim_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by band."""
    return claim_verification(spark, sf_dir).groupBy("band").agg(F.count("*").alias("n"))


CLAIMS_SQL = rf"""WITH {T.LINES_SQL},
s AS (SELECT doc_id // 3 AS sample, doc_id * 100000 + pos AS place, lower(header) AS h, {sql_norm('header')} AS hn, lower(body) AS body FROM lines),
a AS (SELECT doc_id // 3 AS sample, doc_id * 100000 + pos AS claim_id, CASE WHEN doc_id % 2 = 0 THEN body ELSE header || ' 12.5% ' || pos END AS claim,
  CASE pos % 5 WHEN 0 THEN translate(header, '{LOW}', '{LOW.upper()}') WHEN 1 THEN '4.2. ' || header WHEN 2 THEN array_to_string(list_reverse(string_split(header, ' ')), ' ') WHEN 3 THEN right(body, 12) ELSE 'no such section' END AS asked FROM lines),
c AS (SELECT *, lower(asked) AS q, {sql_norm('asked')} AS qn, list_concat(regexp_extract_all(claim, '\d+\.?\d*%?'), list_transform(regexp_extract_all(claim, '[A-Za-z]{{4,}}'), lambda x: lower(x))[1:5]) AS t FROM a),
w AS (SELECT sample, place, h, hn, body, list_distinct(regexp_extract_all(hn, '[^\s]+')) AS hw FROM s),
v AS (SELECT *, list_distinct(regexp_extract_all(qn, '[^\s]+')) AS qw FROM c),
p AS (SELECT v.sample, claim_id, t, w.place, w.body, CASE WHEN len(qw) >= 2 AND len(hw) > 0 THEN len(list_intersect(qw, hw)) / len(qw) ELSE 0 END AS share, h, hn, q, qn FROM v JOIN w ON v.sample = w.sample),
r AS (SELECT *, CASE WHEN contains(h, q) OR contains(q, h) THEN 1 WHEN qn <> '' AND (contains(hn, qn) OR contains(qn, hn)) THEN 2 WHEN share >= 0.6 THEN 3 WHEN length(qn) >= 5 AND (contains(body, qn) OR contains(body, q)) THEN 4 END AS how FROM p),
m AS (SELECT *, len(list_filter(t, lambda x: contains(body, lower(x)))) AS f FROM r WHERE how IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample, claim_id ORDER BY how, CASE WHEN how = 3 THEN -share ELSE 0 END, place) = 1),
b AS (SELECT c.sample, c.claim_id, c.claim = '' OR c.asked = '' AS bare, len(c.t) AS n, m.f, m.how FROM c LEFT JOIN m ON c.sample = m.sample AND c.claim_id = m.claim_id),
claims AS (SELECT sample, claim_id, CASE WHEN bare THEN 'skip_empty' WHEN n = 0 THEN 'skip_no_terms' WHEN how IS NULL THEN 'section_not_found' WHEN f / n >= 0.5 THEN 'confirmed' WHEN f > 0 THEN 'partial' ELSE 'no_match' END AS band,
  CASE WHEN NOT bare THEN how END AS how FROM b)
"""


def termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.struct((F.col("o_custkey") % 5 == 0).alias("submitted"), (F.col("o_orderkey") % 4).alias("run"))
    d = T.table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"), (F.col("o_custkey") * 300).alias("tokens"), (F.col("o_orderkey") % 7 == 0).cast("int").alias("errors"))
    return d.select("o_orderkey", replay.terminated_by("state", F.col("tokens"), F.col("errors")).alias("ended"))


def reply_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels, fenced JSON, names of sections that were read, status lines and choices."""
    k = F.col("c_custkey").cast("string")
    channel = F.concat(F.lit("<|channel|>analysis<|message|>x<|end|><|channel|>final<|message|> "), k, F.lit(" <|end|>"))
    fence = F.concat(F.lit('so\n```json\n{"a": '), k, F.lit("}\n```"))
    out = F.element_at(F.array(F.concat(F.lit("=== S"), k, F.lit(" ===\n\nbody")), F.lit("REJECTED: no"), F.lit("other")), (F.col("c_custkey") % 3 + 1).cast("int"))
    d = T.table(spark, sf_dir, "customer")
    return d.select(
        "c_custkey", R.without_channels(F.when(F.col("c_custkey") % 2 == 0, channel).otherwise(k)).alias("plain"), R.fenced_json(F.when(F.col("c_custkey") % 2 == 0, fence).otherwise("none")).alias("json"),
        report.read_section_name(out, F.lit("asked")).alias("section"), R.status_line(F.col("c_custkey") % 5, F.col("c_custkey") * 7, F.lit(3)).alias("status"), F.md5(R.choice_prompt(F.col("c_name"), F.lit("Q"), F.array(F.lit("x"), F.lit("y")))).alias("choice"),
    )


REPLIES_SQL = """SELECT c_custkey, c_custkey::VARCHAR AS plain, CASE WHEN c_custkey % 2 = 0 THEN '{"a": ' || c_custkey || '}' END AS json, CASE c_custkey % 3 WHEN 0 THEN 'S' || c_custkey WHEN 2 THEN 'asked' END AS section,
chr(10) || 'Turn: ' || (c_custkey % 5 + 1) || '  |  Tokens used: ' || format('{:,}', c_custkey * 7) || '  |  Budget used: 3' AS status,
md5('Context:' || chr(10) || c_name || chr(10) || chr(10) || 'Question: Q' || chr(10) || chr(10) || 'Options:' || chr(10) || 'A. x' || chr(10) || 'B. y' || chr(10) || chr(10) || 'Reply as JSON: {"answer": "<letter>"}') AS choice FROM customer"""


def graph_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps around each supplier packed as a graph, with the content of its papers, pruned to a list."""
    seeds = T.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("seed"))
    p = T.table(spark, sf_dir, "part")
    papers = p.select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("x"), "p_partkey")).alias("arxivId"), F.col("p_size").cast("int").alias("year"), F.lit("").alias("abstract"))
    g = bundle.package(graph.two_hop(T.edges(spark, sf_dir), seeds, 5), papers)
    pool = p.where("p_size > 20").select(F.concat(F.lit("x"), "p_partkey").alias("arxiv_id"), F.array("p_name").alias("sections"))
    full = bundle.load(seeds.withColumnRenamed("seed", "id"), g, pool)
    keep = full.select("id", F.filter(F.map_keys("content"), lambda k: F.endswith(k, F.lit("1"))).alias("ids"))
    d = bundle.prune(full, keep)
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return d.select("id", size("nodes").alias("nodes"), size("edges").alias("sources"), F.coalesce(F.aggregate(F.map_values("edges"), F.lit(0), lambda n, e: n + F.size(e)), F.lit(0)).alias("links"), size("content").alias("kept"))


PACKAGE_SQL = f"""WITH {T.EDGES_SQL}, h AS (SELECT a.src AS seed, a.dst AS mid, b.dst AS node FROM edges a JOIN edges b ON b.src = a.dst WHERE a.pos <= 5 AND b.pos <= 5 AND b.dst <> a.src AND a.src IN (SELECT 'S' || s_suppkey FROM supplier)),
n AS (SELECT seed, seed AS id FROM h UNION SELECT seed, mid FROM h UNION SELECT seed, node FROM h), l AS (SELECT seed, seed AS a, mid AS b FROM h UNION SELECT seed, mid, node FROM h),
k AS (SELECT seed, count(*) AS kept FROM n JOIN part ON id = 'P' || p_partkey WHERE p_size > 20 AND p_partkey % 3 > 0 AND p_partkey % 10 = 1 GROUP BY 1),
c AS (SELECT seed, count(*) AS nodes FROM n GROUP BY 1), e AS (SELECT seed, count(DISTINCT a) AS sources, count(*) AS links FROM l GROUP BY 1)
SELECT 'S' || s_suppkey AS id, coalesce(nodes, 0) AS nodes, coalesce(sources, 0) AS sources, coalesce(links, 0) AS links, coalesce(kept, 0) AS kept FROM supplier LEFT JOIN c ON c.seed = 'S' || s_suppkey LEFT JOIN e ON e.seed = 'S' || s_suppkey LEFT JOIN k ON k.seed = 'S' || s_suppkey"""


def section_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that trajectories read, out of their nested turns."""
    c = T.calls(spark, sf_dir)
    result = lambda x: F.struct(x["tool"].alias("name"), F.concat(F.lit("=== S"), x["paper"] % 3, F.lit(" ===\n\nx")).alias("output"), F.create_map(F.lit("paper_id"), x["paper"].cast("string"), F.lit("section"), F.lit("q")).alias("args"))
    turns = c.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "tool", "paper"))).alias("e"))
    t = turns.select(F.col("sample").alias("sample_id"), F.transform("e", lambda x: F.struct(F.array(result(x)).alias("tool_results"))).alias("turns"))
    nodes = c.select("sample", F.col("paper").cast("string").alias("pid"), F.when(F.col("paper") % 4 > 0, F.concat(F.lit("x"), F.col("paper"))).otherwise("").alias("arxiv_id")).distinct()
    return report.section_reads(t, nodes).groupBy("sample", "paper", "section").agg(F.count("*").alias("n"))


def case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "vf").otherwise("us"), F.lit("_q_"), "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "_c").otherwise("_l"), F.col("o_orderkey") % 12).alias("case_id"))
    return audit.case_parts(d).select("o_orderkey", "kind", "sample", "idx")


def _client(prompts: list[str]) -> list[str | None]:
    """Answers in capitals; none where a prompt has no s."""
    return [p.upper() if "s" in p else None for p in prompts]


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("prompt"))
    return construction.ask_model(d, _client, failed="none")


def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after the suppliers, with ids that go on counting."""
    old = T.table(spark, sf_dir, "supplier").select(F.concat(F.lit("q_"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0")).alias("id"), F.col("s_name").alias("name"))
    new = T.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), "c_acctbal", "c_custkey")
    return files.append_with_ids(old, new, "id", "q_", ["c_acctbal", "c_custkey"]).select("id", "name")


QUERIES = {
    "claim_verification": (claim_verification, CLAIMS_SQL + "SELECT * FROM claims"),
    "claim_tally": (claim_tally, CLAIMS_SQL + "SELECT band, count(*) AS n FROM claims GROUP BY 1"),
    "termination": (termination, "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'error' WHEN o_custkey % 5 = 0 THEN 'answer' WHEN o_custkey * 300 > 200000 THEN 'token_limit' WHEN o_orderkey % 4 >= 2 THEN 'budget' ELSE 'max_turns' END AS ended FROM orders"),
    "reply_forms": (reply_forms, REPLIES_SQL),
    "graph_package": (graph_package, PACKAGE_SQL),
    "section_reads": (section_reads, f"WITH {T.CALLS_SQL} SELECT sample, 'x' || paper AS paper, 'S' || (paper % 3) AS section, count(*) AS n FROM calls WHERE tool = 'read_section' AND paper % 4 > 0 GROUP BY 1, 2, 3"),
    "case_ids": (case_ids, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'vf' ELSE 'us' END AS kind, 'q_' || o_custkey AS sample, (o_orderkey % 12)::INT AS idx FROM orders"),
    "model_calls": (model_calls, "SELECT p_partkey AS id, CASE WHEN contains(p_name, 's') THEN upper(p_name) ELSE 'none' END AS reply FROM part"),
    "appended_rows": (appended_rows, "WITH n AS (SELECT count(*) AS n FROM supplier), c AS (SELECT c_name, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 + n AS k FROM customer, n) SELECT 'q_' || lpad(s_suppkey::VARCHAR, 4, '0') AS id, s_name AS name FROM supplier UNION ALL SELECT 'q_' || lpad(k::VARCHAR, greatest(4, length(k::VARCHAR))::INT, '0'), c_name FROM c"),
}
