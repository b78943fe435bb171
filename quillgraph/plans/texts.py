"""Queries of the text functions, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import sections as S
from quillgraph.functions import text as X
from quillgraph.functions import toolcalls
from quillgraph.operators import sampling
from quillgraph.plans import tables as T
from quillgraph.sources import papers


def sql_norm(x: str) -> str:
    x = f"trim(lower({x}), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    for p in (r"^apdx_[a-z][\d.]*:\s*", r"^apdx:\s*", r"^[ivxlc]+-?[a-z]?\s+", r"^[\d.]+\s*"):
        x = f"regexp_replace({x}, '{p}', '')"
    return rf"trim(regexp_replace(regexp_replace({x}, '[:\-–—]', ' ', 'g'), '\s+', ' ', 'g'))"


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as headers with numbering and appendix marks put before some of them."""
    d = T.lines(spark, sf_dir).where("header <> ''")
    mark = F.element_at(F.array(*(F.lit(x) for x in ("", "IV-B ", "4.2. ", "Apdx_B.2: ", "Apdx: ", "xi  ", "A:B - "))), (F.col("pos") + F.col("doc_id")).cast("int") % 7 + 1)
    return d.select("doc_id", "pos", F.concat(mark, F.col("header")).alias("header"))


HEADERS_SQL = T.LINES_SQL + ",\nheaders AS (SELECT doc_id, pos, ['', 'IV-B ', '4.2. ', 'Apdx_B.2: ', 'Apdx: ', 'xi  ', 'A:B - '][(pos + doc_id) % 7 + 1] || header AS header FROM lines WHERE header <> '')"


def normalize_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headers(spark, sf_dir).select("doc_id", "pos", X.normalize_header(F.col("header")).alias("norm"))


def section_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _headers(spark, sf_dir).select("doc_id", "pos", X.section_keys(F.col("header")).alias("keys"))
    q = _headers(spark, sf_dir).select("doc_id", F.col("pos").alias("qpos"), X.section_keys(F.lower("header")).alias("query"))
    return q.join(h, "doc_id").where(X.keys_match(F.col("query"), F.col("keys"))).groupBy("doc_id").agg(F.count("*").alias("hits"), F.sum(F.col("qpos") * 1000 + F.col("pos")).alias("which"))


MATCH_SQL = f"""WITH {HEADERS_SQL},
n AS (SELECT *, {sql_norm('header')} AS norm FROM headers),
q AS (SELECT doc_id, pos AS qpos, lower(header) AS query, {sql_norm('lower(header)')} AS qn FROM headers),
j AS (SELECT q.doc_id, qpos, pos, list_distinct(regexp_extract_all(qn, '[^\\s]+')) AS qw, list_distinct(regexp_extract_all(norm, '[^\\s]+')) AS tw,
  contains(lower(header), query) OR contains(query, lower(header)) AS raw, qn <> '' AND norm <> '' AS named, contains(norm, qn) OR contains(qn, norm) AS sub FROM q JOIN n ON q.doc_id = n.doc_id)
SELECT doc_id, count(*) AS hits, sum(qpos * 1000 + pos)::BIGINT AS which FROM j
WHERE raw OR (named AND (sub OR (len(qw) >= 2 AND len(tw) > 0 AND len(list_intersect(qw, tw)) / len(qw) >= 0.6))) GROUP BY doc_id"""


def theta_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of each document that match no line of the next document."""
    d = _headers(spark, sf_dir).select("doc_id", "header").distinct()
    h = d.groupBy("doc_id").agg(F.collect_list(X.section_keys(F.col("header"))).alias("keys"))
    q = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("header").alias("query"), X.section_keys(F.col("header")).alias("own"))
    return q.join(h, "doc_id").where(~F.exists("keys", lambda k: X.keys_match(F.col("own"), k))).select("doc_id", "query")


ANTI_SQL = f"""WITH {HEADERS_SQL},
n AS (SELECT *, {sql_norm('header')} AS norm FROM headers),
q AS (SELECT DISTINCT doc_id + 1 AS doc_id, header AS query, {sql_norm('header')} AS qn FROM headers),
hit AS (SELECT DISTINCT q.doc_id, q.query FROM q JOIN n ON q.doc_id = n.doc_id WHERE contains(lower(header), lower(query)) OR contains(lower(query), lower(header)) OR (qn <> '' AND norm <> '' AND (contains(norm, qn) OR contains(qn, norm)
  OR (len(list_distinct(regexp_extract_all(qn, '[^\\s]+'))) >= 2 AND len(list_intersect(list_distinct(regexp_extract_all(qn, '[^\\s]+')), list_distinct(regexp_extract_all(norm, '[^\\s]+')))) / len(list_distinct(regexp_extract_all(qn, '[^\\s]+'))) >= 0.6))))
SELECT q.doc_id, q.query FROM q ANTI JOIN hit USING (doc_id, query) WHERE doc_id IN (SELECT doc_id FROM n)"""


def section_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("i"))
    a = X.section_alias(F.col("i"))
    return d.select("i", a.alias("alias"), X.alias_index(a).cast("int").alias("back"))


def match_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _headers(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "header"))), lambda x: F.struct(x["header"].alias("header"))).alias("sections"))
    q = F.element_at(F.array(F.lit("(B)"), F.concat(F.lit(" "), F.get("sections", F.lit(0))["header"]), F.split(F.get("sections", F.lit(1))["header"], " ")[0], F.lit("zz top"), F.lit("ABC")), (F.col("doc_id") % 5 + 1).cast("int"))
    return h.select("doc_id", S.match_section(q, F.col("sections")).alias("section"))


MATCH_SECTION_SQL = f"""WITH {HEADERS_SQL},
a AS (SELECT doc_id, list(header ORDER BY pos) AS hs FROM headers GROUP BY doc_id),
b AS (SELECT doc_id, hs, CASE doc_id % 5 WHEN 0 THEN '(B)' WHEN 1 THEN ' ' || hs[1] WHEN 2 THEN string_split(hs[2], ' ')[1] WHEN 3 THEN 'zz top' ELSE 'ABC' END AS q0 FROM a),
c AS (SELECT doc_id, hs, trim(q0) AS q, lower(trim(q0)) AS ql, {sql_norm('q0')} AS qn, regexp_extract(upper(trim(q0)), '^\\(?([A-Z]{{1,3}})\\)?$', 1) AS al, list_transform(hs, lambda h: {sql_norm('h')}) AS ns FROM b),
d AS (SELECT *, CASE WHEN len(al) = 1 THEN ascii(al) - 65 WHEN len(al) = 2 THEN (ascii(al[1]) - 64) * 26 + ascii(al[2]) - 65 WHEN len(al) = 3 THEN ((ascii(al[1]) - 64) * 26 + ascii(al[2]) - 64) * 26 + ascii(al[3]) - 65 END AS ai,
  list_filter(range(1, len(hs) + 1), lambda i: lower(trim(hs[i])) = ql) AS p2, list_filter(range(1, len(hs) + 1), lambda i: qn <> '' AND ns[i] = qn) AS p3,
  list_filter(range(1, len(hs) + 1), lambda i: contains(lower(hs[i]), ql)) AS p4, list_filter(range(1, len(hs) + 1), lambda i: qn <> '' AND contains(ns[i], qn)) AS p5 FROM c)
SELECT doc_id, CASE WHEN q IS NULL OR q = '' THEN NULL WHEN ai IS NOT NULL AND ai < len(hs) THEN ai WHEN len(p2) > 0 THEN p2[1] - 1 WHEN len(p3) > 0 THEN p3[1] - 1 WHEN len(p4) = 1 THEN p4[1] - 1 WHEN len(p5) = 1 THEN p5[1] - 1 END AS section FROM d"""


def answer_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["A", "(b)", " C. ", "d)", "(a).", "B because", "", "E", "(C):", "AB"]
    d = T.table(spark, sf_dir, "orders")
    return d.select("o_orderkey", X.answer_index(F.element_at(F.array(*map(F.lit, forms)), (F.col("o_orderkey") % 10 + 1).cast("int"))).alias("idx"))


def word_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document with the next."""
    d = T.lines(spark, sf_dir).select("doc_id", "pos", "body")
    n = d.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("body").alias("after"))
    return d.join(n, ["doc_id", "pos"]).select("doc_id", "pos", X.word_jaccard(F.col("body"), F.col("after")).alias("jaccard"))


def numeric_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.col("l_quantity").cast("int"), F.col("l_linenumber")))), ", ").alias("a"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", F.col("l_linenumber"), (F.col("l_quantity") + F.col("l_linenumber") % 2).cast("int")))), " and ").alias("b"))
    return d.select("l_orderkey", X.numeric_overlap(F.col("a"), F.col("b")).alias("overlap"))


NUMERIC_SQL = r"""WITH d AS (SELECT l_orderkey, array_to_string(list_sort(list(l_quantity::INT || ' ' || l_linenumber)), ', ') AS a, array_to_string(list_sort(list(l_linenumber || '/' || (l_quantity + l_linenumber % 2)::INT)), ' and ') AS b FROM lineitem GROUP BY 1),
n AS (SELECT l_orderkey, list_filter(list_distinct(regexp_extract_all(a, '\d+\.?\d*')), lambda x: x NOT IN ('0','1','2','3','4','5')) AS x, list_filter(list_distinct(regexp_extract_all(b, '\d+\.?\d*')), lambda y: y NOT IN ('0','1','2','3','4','5')) AS y FROM d)
SELECT l_orderkey, CASE WHEN len(x) >= 2 AND len(y) >= 2 THEN len(list_intersect(x, y)) / len(x) ELSE 0.0 END AS overlap FROM n"""


def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.concat(F.lit("see (A, "), F.year("o_orderdate"), F.lit("; B, 1999"), F.when(F.col("o_orderkey") % 3 == 0, "; C, 2001").otherwise(""), F.lit(") and "), F.when(F.col("o_orderkey") % 2 == 0, "(D, 2010)").otherwise("(nobody)"))
    d = T.table(spark, sf_dir, "orders").select("o_orderkey", c.alias("c"))
    return d.select("o_orderkey", X.citations_in(F.col("c")).alias("n"), X.specificity(F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("c", F.lit("none")))).alias("best"))


CITATIONS_SQL = r"""WITH d AS (SELECT o_orderkey, 2 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS n FROM orders)
SELECT o_orderkey, n, CASE WHEN o_orderkey % 5 = 0 THEN 99 ELSE least(n, 1) END AS best FROM d"""

_PHRASES = ["We improve on and address a limitation", "in contrast to X, unlike Y", "it extends and adapts, compared to Z", "originally proposed by A", "contradicts B", "evaluated on C using the data", "as shown in D", "nothing here", "superior, builds upon and refines it"]


def context_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", *(F.element_at(F.array(*map(F.lit, _PHRASES)), (F.floor(F.col("o_orderkey") / m) % 9 + 1).cast("int")) for m in (1, 9))).alias("t"))
    d = d.withColumn("kind", X.context_type(F.col("t")))
    return d.select("o_orderkey", "kind", X.relation(F.array("kind", F.lit("comparison"), F.when(F.col("o_orderkey") % 2 == 0, "evolution").otherwise("provenance"))).alias("relation"))


def _sql_phrases() -> str:
    arr = "[" + ", ".join(f"'{p}'" for p in _PHRASES) + "]"
    scores = ", ".join(f"{{'n': {' + '.join(f'regexp_matches(t, $x$(?i){p}$x$)::INT' for p in ps)}, 'o': {-i}, 't': '{k}'}}" for i, (k, ps) in enumerate(X.CONTEXT_TYPES.items()))
    rel = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.RELATION_OF.items()) + " END"
    return f"""WITH d AS (SELECT o_orderkey, {arr}[o_orderkey % 9 + 1] || ' ' || {arr}[o_orderkey // 9 % 9 + 1] AS t FROM orders),
s AS (SELECT o_orderkey, list_reverse_sort([{scores}])[1] AS b FROM d),
k AS (SELECT o_orderkey, CASE WHEN b.n > 0 THEN b.t ELSE 'unclassified' END AS kind FROM s),
r AS (SELECT o_orderkey, kind, {rel} AS r FROM k)
SELECT o_orderkey, kind, CASE WHEN r = 'METHOD' THEN 'METHOD' WHEN r = 'RESULT' THEN 'RESULT' ELSE r END AS relation FROM r"""


def answer_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    k = X.answer_keywords(F.col("text"))
    return d.select("doc_id", F.array_join(k, "|").alias("keywords"), X.found_in(k, F.upper("text")).alias("found"))


KEYWORDS_SQL = r"""WITH k AS (SELECT doc_id, text, list_concat(list_concat(regexp_extract_all(text, '\d+\.?\d*%?')[1:5], regexp_extract_all(text, '[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+')[1:3]), list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z]{2,}'))[1:3])[1:8] AS k FROM documents)
SELECT doc_id, array_to_string(k, '|') AS keywords, len(list_filter(k, lambda x: contains(upper(text), x))) AS found FROM k"""


def claim_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a claim against the document of the same number."""
    b = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("claim"))
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("body"))
    j = b.join(d, "doc_id").withColumn("terms", X.claim_terms(F.col("claim")))
    return j.select("doc_id", F.size("terms").alias("n_terms"), X.claim_band(F.col("terms"), F.col("body")).alias("band"))


CLAIM_SQL = r"""WITH j AS (SELECT d.doc_id, lower(d.text) AS body, list_concat(regexp_extract_all(b.text, '\d+\.?\d*%?'), list_transform(regexp_extract_all(b.text, '[A-Za-z]{4,}'), lambda x: lower(x))[1:5]) AS t FROM benchmark b JOIN documents d ON b.item_id = d.doc_id),
f AS (SELECT *, len(list_filter(t, lambda x: contains(body, lower(x)))) AS f FROM j)
SELECT doc_id, len(t) AS n_terms, CASE WHEN len(t) = 0 THEN 'skip_no_terms' WHEN f / len(t) >= 0.5 THEN 'confirmed' WHEN f > 0 THEN 'partial' ELSE 'no_match' END AS band FROM f"""


def text_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(X.cut(F.col("text"), 300)).alias("short"), F.length(X.sentence_cut(F.col("text"))).alias("sentence"))


CUTS_SQL = """WITH h AS (SELECT doc_id, text, text[1:500] AS head FROM documents), r AS (SELECT *, length(head) - strpos(reverse(head), ' .') - 1 AS l, strpos(reverse(head), ' .') > 0 AS e FROM h)
SELECT doc_id, md5(CASE WHEN length(text) > 300 THEN text[1:300] || '...' ELSE text END) AS short, CASE WHEN length(text) <= 500 THEN length(text) WHEN e AND l > 200 THEN l + 1 ELSE 500 END AS sentence FROM r"""


def clean_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "orders")
    t = F.concat(F.lit("as in [ "), F.col("o_custkey"), F.lit(" ] and [ 20 , "), F.col("o_custkey"), F.lit("  ,4 ] but [x] not"))
    return d.select("o_orderkey", X.clean_brackets(t).alias("clean"))


BRACKETS_SQL = "SELECT o_orderkey, 'as in [' || o_custkey || '] and [20, ,, ' || o_custkey || ', ,4] but [x] not' AS clean FROM orders"


def section_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Introduction", "Results", "Our Method", "Ablation", "Appendix", "Model setup"]
    d = T.lines(spark, sf_dir).withColumn("header", F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") * 5 + F.col("pos") * 5).cast("int") % 6 + 1))
    s = d.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "header", "body"))), lambda x: F.struct(x["header"].alias("header"), x["body"].alias("text"))).alias("s"))
    rel = S.relevant(F.col("s"), "RESULT", 200)
    return s.select("doc_id", F.md5(S.as_text(F.col("s"))).alias("ordered"), F.array_join(F.transform(rel, lambda x: x["header"]), "|").alias("relevant"), F.md5(S.listing(F.col("s"))).alias("listing"))


ORDERS_SQL = """WITH {lines},
n AS (SELECT doc_id, pos, body, ['Introduction', 'Results', 'Our Method', 'Ablation', 'Appendix', 'Model setup'][(doc_id * 5 + pos * 5) % 6 + 1] AS h FROM lines),
k AS (SELECT *, CASE WHEN h IN ('Results', 'Ablation') THEN 0 WHEN h IN ('Our Method', 'Model setup') THEN 1 ELSE 2 END AS rk FROM n)
SELECT doc_id, md5(array_to_string(list('### ' || h || chr(10) || body ORDER BY rk, pos), chr(10) || chr(10))) AS ordered,
  CASE WHEN coalesce(sum(length(body)) FILTER (WHERE rk = 0), 0) < 200 THEN array_to_string(list(h ORDER BY pos), '|') ELSE array_to_string(list(h ORDER BY pos) FILTER (WHERE rk = 0), '|') END AS relevant,
  md5(array_to_string(list('(' || CASE WHEN pos < 26 THEN chr(65 + pos::INT) ELSE chr(64 + pos::INT // 26) || chr(65 + pos::INT % 26) END || ') ' || h || ' [' || length(body) || ' chars]' ORDER BY pos), chr(10))) AS listing FROM k GROUP BY doc_id""".replace("{lines}", T.LINES_SQL)


def appendix_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.lines(spark, sf_dir).withColumn("header", F.when(F.col("pos") % 2 == 1, F.concat(F.lit("Apdx_"), F.col("pos"))).otherwise(F.concat(F.lit("S"), F.col("pos"))))
    s = d.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "header", "body"))), lambda x: F.struct(x["header"].alias("header"), x["body"].alias("text"))).alias("s"))
    return s.select("doc_id", F.md5(S.capped_text(F.col("s"), 400)).alias("capped"))


CAP_SQL = f"""WITH RECURSIVE {T.LINES_SQL},
a AS (SELECT doc_id, pos, body, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM lines WHERE pos % 2 = 1),
c(doc_id, k, used, txt, pos) AS (
  SELECT doc_id, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM (SELECT DISTINCT doc_id FROM a)
  UNION ALL
  SELECT c.doc_id, a.k, CASE WHEN c.used >= 400 THEN c.used ELSE c.used + length(CASE WHEN length(body) > 400 - c.used THEN body[1:(400 - c.used)] || chr(10) || '[...truncated, ' || (length(body) - 400 + c.used) || ' chars omitted]' ELSE body END) END,
    CASE WHEN c.used >= 400 THEN NULL WHEN length(body) > 400 - c.used THEN body[1:(400 - c.used)] || chr(10) || '[...truncated, ' || (length(body) - 400 + c.used) || ' chars omitted]' ELSE body END, a.pos
  FROM c JOIN a ON c.doc_id = a.doc_id AND a.k = c.k + 1),
z AS (SELECT doc_id, pos, chr(10) || '## S' || pos || chr(10) || body AS t FROM lines WHERE pos % 2 = 0 UNION ALL SELECT doc_id, pos, chr(10) || '## Apdx_' || pos || chr(10) || txt FROM c WHERE txt IS NOT NULL)
SELECT doc_id, md5(array_to_string(list(t ORDER BY pos), chr(10))) AS capped FROM z GROUP BY doc_id"""


def hash_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = {"retrieve": 30, "reason": 25, "contrast": 15, "assess": 10, "synthesize": 10, "justify": 10}
    u = sampling.unit_hash(F.lit("42"), F.col("o_orderkey").cast("string"))
    return T.table(spark, sf_dir, "orders").select("o_orderkey", sampling.weighted_draw(u, w).alias("skill"))


def option_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sampling.shuffled(F.concat(F.lit("7_"), F.col("o_orderkey").cast("string")))
    return T.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(p, lambda x: x.cast("string")), "").alias("options"), (F.array_position(p, F.lit(0)) - 1).cast("int").alias("correct_index"))


def survey_and_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.element_at(F.array(F.lit("A Survey of X"), F.lit("Deep nets"), F.lit("論文 title"), F.lit("Position Paper: y"), F.lit("한국"), F.lit(None)), (F.col("p_partkey") % 6 + 1).cast("int"))
    kinds = F.when(F.col("p_size") % 7 == 0, F.array(F.lit("Review"))).when(F.col("p_size") % 7 == 1, F.array(F.lit("Journal")))
    return T.table(spark, sf_dir, "part").select("p_partkey", X.is_survey(t, kinds).alias("survey"), X.has_cjk(t).alias("cjk"))


def authors_and_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("c_custkey") % 4).cast("int")
    names = F.slice(F.array(F.lit("Ann"), F.lit("Bo"), F.lit("Cy")), F.lit(1), n)
    err = F.element_at(F.array(F.lit("HTTP 429"), F.lit("Rate limit"), F.lit("bad key"), F.lit("server 503"), F.lit("Overloaded now")), (F.col("c_custkey") % 5 + 1).cast("int"))
    return T.table(spark, sf_dir, "customer").select("c_custkey", X.author_short(names).alias("authors"), X.is_transient(err).alias("transient"), F.md5(X.context_list(names)).alias("listed"))


_OK = "SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 0 WHEN 8 THEN 2 ELSE -1 END AS idx FROM orders"
QUERIES = {
    "normalize_header": (normalize_header, f"WITH {HEADERS_SQL} SELECT doc_id, pos, {sql_norm('header')} AS norm FROM headers"),
    "section_match_join": (section_match_join, MATCH_SQL.replace("\\\\s", "\\s")),
    "theta_anti": (theta_anti, ANTI_SQL.replace("\\\\s", "\\s")),
    "section_alias": (section_alias, "SELECT p_partkey::INT AS i, CASE WHEN p_partkey < 26 THEN chr(65 + p_partkey::INT) WHEN p_partkey < 702 THEN chr(64 + p_partkey::INT // 26) || chr(65 + p_partkey::INT % 26) ELSE chr(65 + (p_partkey::INT - 702) // 676) || chr(65 + (p_partkey::INT - 702) // 26 % 26) || chr(65 + (p_partkey::INT - 702) % 26) END AS alias, p_partkey::INT AS back FROM part"),
    "match_section": (match_section, MATCH_SECTION_SQL.replace("\\\\(", "\\(").replace("\\\\)", "\\)")),
    "answer_letter": (answer_letter, _OK),
    "word_jaccard": (word_jaccard, rf"WITH {T.LINES_SQL}, w AS (SELECT x.doc_id, x.pos, list_distinct(regexp_extract_all(lower(x.body), '[^\s]+')) AS a, list_distinct(regexp_extract_all(lower(y.body), '[^\s]+')) AS b FROM lines x JOIN lines y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1) SELECT doc_id, pos, coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0), 0) AS jaccard FROM w"),
    "numeric_overlap": (numeric_overlap, NUMERIC_SQL),
    "citation_counts": (citation_counts, CITATIONS_SQL),
    "context_types": (context_types, _sql_phrases()),
    "answer_keywords": (answer_keywords, KEYWORDS_SQL),
    "claim_bands": (claim_bands, CLAIM_SQL),
    "text_cuts": (text_cuts, CUTS_SQL),
    "clean_brackets": (clean_brackets, BRACKETS_SQL),
    "section_orders": (section_orders, ORDERS_SQL),
    "appendix_cap": (appendix_cap, CAP_SQL),
    "hash_draw": (hash_draw, "WITH u AS (SELECT o_orderkey, ('0x' || md5('42|' || o_orderkey)[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS u FROM orders) SELECT o_orderkey, CASE WHEN u < 0.3 THEN 'retrieve' WHEN u < 0.55 THEN 'reason' WHEN u < 0.7 THEN 'contrast' WHEN u < 0.8 THEN 'assess' WHEN u < 0.9 THEN 'synthesize' ELSE 'justify' END AS skill FROM u"),
    "option_shuffle": (option_shuffle, "WITH o AS (SELECT o_orderkey, i, md5('7_' || o_orderkey || '|' || i) AS h FROM orders, range(4) t(i)), a AS (SELECT o_orderkey, list(i ORDER BY h) AS l FROM o GROUP BY 1) SELECT o_orderkey, array_to_string(l, '') AS options, (list_position(l, 0) - 1)::INT AS correct_index FROM a"),
    "survey_and_cjk": (survey_and_cjk, "SELECT p_partkey, p_partkey % 6 IN (0, 3) OR p_size % 7 = 0 AS survey, p_partkey % 6 IN (2, 4) AS cjk FROM part"),
    "authors_and_errors": (authors_and_errors, """WITH c AS (SELECT c_custkey, c_custkey % 4 AS n FROM customer) SELECT c_custkey, ['Unknown', 'Ann', 'Ann and Bo', 'Ann et al.'][n + 1] AS authors, c_custkey % 5 <> 2 AS transient,
  md5(['(no citation context available)', '  [1] "Ann"', '  [1] "Ann"' || chr(10) || '  [2] "Bo"', '  [1] "Ann"' || chr(10) || '  [2] "Bo"' || chr(10) || '  [3] "Cy"'][n + 1]) AS listed FROM c"""),
}


def tool_call_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and turns of conversations with a call of their own words in one of five notations, by SQL."""
    docs = T.table(spark, sf_dir, "documents").selectExpr("concat('d', doc_id) AS k", "doc_id % 5 AS f", "text")
    turns = T.table(spark, sf_dir, "conversations").selectExpr("concat('c', conv_id, '-', turn) AS k", "(conv_id + turn) % 5 AS f", "text")
    v = "regexp_replace(split(text, '\n')[0], '[^A-Za-z0-9 ]', '')"
    forms = [
        f"""concat(text, ' <tool_call>{{"name": "think", "arguments": {{"a": "', {v}, '"}}}}</tool_call>')""", f"""concat('```tool_code\nread_section(paper_id="', {v}, '", n=', length(text), ')\n```\n', text)""",
        f"""concat('I call {{"name": "search_papers", "arguments": {{"q": "', {v}, '"}}}} now ', text)""", f"""concat(text, '\nso [think(a=', length(text), '), get_references(b="', {v}, '")]')""",
        f"""concat(text, '\nget_references(paper_id="', {v}, '")')""",
    ]
    toolcalls.register(spark)
    texts = docs.unionByName(turns).selectExpr("k", f"CASE f {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(forms))} END AS t")
    return spark.sql("SELECT k, c.id, c.name, array_join(array_sort(transform(map_entries(c.args), e -> concat(e.key, '=', e.value))), ',') AS args FROM {texts}, LATERAL tool_calls(t) c", texts=texts)


CALLS_SQL = r"""WITH x AS (SELECT 'd' || doc_id AS k, doc_id % 5 AS f, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, (conv_id + turn) % 5, text FROM conversations),
y AS (SELECT *, regexp_replace(string_split(text, chr(10))[1], '[^A-Za-z0-9 ]', '', 'g') AS v FROM x WHERE text IS NOT NULL),
t AS (SELECT k, CASE f WHEN 0 THEN text || ' <tool_call>{"name": "think", "arguments": {"a": "' || v || '"}}</tool_call>' WHEN 1 THEN '```tool_code' || chr(10) || 'read_section(paper_id="' || v || '", n=' || length(text) || ')' || chr(10) || '```' || chr(10) || text
  WHEN 2 THEN 'I call {"name": "search_papers", "arguments": {"q": "' || v || '"}} now ' || text WHEN 3 THEN text || chr(10) || 'so [think(a=' || length(text) || '), get_references(b="' || v || '")]' ELSE text || chr(10) || 'get_references(paper_id="' || v || '")' END AS t FROM y)
SELECT k, 'text_1' AS id, regexp_extract(t, '"name": "(\w+)"', 1) AS name, regexp_extract(t, '"arguments": \{"(\w)": "', 1) || '=' || regexp_extract(t, '"arguments": \{"\w": "([^"]*)"', 1) AS args FROM t WHERE regexp_matches(t, '\{"name": "')
UNION ALL SELECT k, 'text_1', 'read_section', 'n=' || regexp_extract(t, ', n=(\d+)\)', 1) || ',paper_id=' || regexp_extract(t, 'read_section\(paper_id="([^"]*)"', 1) FROM t WHERE t LIKE '```tool_code%'
UNION ALL SELECT k, 'text_1', 'think', 'a=' || regexp_extract(t, '\nso \[think\(a=(\d+)\)', 1) FROM t WHERE regexp_matches(t, '\nso \[think\(a=\d+\), get_references\(b="[^"]*"\)\]$')
UNION ALL SELECT k, 'text_2', 'get_references', 'b=' || regexp_extract(t, 'get_references\(b="([^"]*)"\)\]$', 1) FROM t WHERE regexp_matches(t, '\nso \[think\(a=\d+\), get_references\(b="[^"]*"\)\]$')
UNION ALL SELECT k, 'text_1', 'get_references', 'paper_id=' || regexp_extract(t, '\nget_references\(paper_id="([^"]*)"\)$', 1) FROM t WHERE regexp_matches(t, '\nget_references\(paper_id="[^"]*"\)$')""".replace("\\\\", "\\")


def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as papers: counts, the first header, and md5 of all headers, texts and cells."""
    d = papers.parse_papers(T.table(spark, sf_dir, "pages"), "page_id", "html")
    whole = F.array_join(F.transform("sections", lambda s: F.concat(s["header"], F.lit("="), s["text"])), "|")
    cells = F.array_join(F.transform("tables", lambda t: F.concat(t["caption"], F.lit("="), F.array_join(F.flatten(t["rows"]), ","))), "|")
    return d.select("page_id", F.size("sections").alias("n_sections"), F.size("tables").alias("n_tables"), F.get("sections", F.lit(0))["header"].alias("header"), F.md5(whole).alias("sections"), F.md5(cells).alias("tables"))


HTML_SQL = papers.sql_of("SELECT page_id AS k, html FROM pages") + """
SELECT k AS page_id, len(sections)::INT AS n_sections, len(tables)::INT AS n_tables, sections[1].header AS header,
  md5(array_to_string(list_transform(sections, lambda s: s.header || '=' || s.text), '|')) AS sections, md5(array_to_string(list_transform(tables, lambda t: t.caption || '=' || array_to_string(flatten(t.rows), ',')), '|')) AS tables FROM result"""


QUERIES["tool_call_texts"] = (tool_call_texts, CALLS_SQL)
QUERIES["html_sections"] = (html_sections, HTML_SQL)


def html_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made by a rule: numbered and appendix sections, references, a table; every fifth has none."""
    k = F.col("o_orderkey").cast("string")
    page = F.concat(
        F.lit("<html><body><section><h2>"), k, F.lit(". Intro "), F.col("o_orderstatus"), F.lit("</h2><p>First <b>words</b> of "), k, F.lit(".</p><p>More.</p></section><section><h2>Appendix B Proofs</h2><p>A &amp; b</p></section>"),
        F.lit("<section><h2>References</h2><p>[1]</p></section>"), F.when(F.col("o_orderkey") % 3 == 0, F.lit('<figure class="ltx_table"><figcaption class="ltx_caption">Cap</figcaption><table><tr><th>a</th><td>b</td></tr></table></figure>')).otherwise(""), F.lit("</body></html>"),
    )
    d = T.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, page).otherwise("<p></p>").alias("html"))
    p = papers.counted(papers.parse_papers(d, "o_orderkey", "html"))
    return p.select("o_orderkey", "n_sections", "n_tables", F.array_join(F.transform("sections", lambda s: F.concat(s["header"], F.lit("="), s["text"])), "|").alias("sections"))


QUERIES["html_rules"] = (html_rules, """SELECT o_orderkey, 2 AS n_sections, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n_tables, 'Intro ' || o_orderstatus || '=First words of ' || o_orderkey || '. More.|Apdx_B: Proofs=A & b' AS sections FROM orders WHERE o_orderkey % 5 > 0""")
