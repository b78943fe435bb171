"""Steps whose cost once grew faster than their input, or was paid twice: results, and what their plans hold."""

import random

from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import bundle, ensemble, graph
from quillgraph.plans import catalog
from quillgraph.plans import tables as T


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gates_in_one_pass(spark, sf):
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.choice([1, 2, 3, None]), rng.choice("AB"), "A") for _ in range(200)]
    v = spark.createDataFrame(rows, "qid int, paper int, answer string, truth string")
    papers = v.groupBy("qid").agg(F.count_distinct("paper").alias("papers"))
    a, b, c = ensemble.gate_a(v), ensemble.gate_b(v, 1), ensemble.gate_c(v, papers)
    want = a.withColumnRenamed("passed", "a_passed").join(b, "qid").join(c.withColumnsRenamed({"right": "c_right", "passed": "c_passed"}), "qid")
    got = ensemble.gates(v, b=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert plan(catalog.QUERIES["vote_gates"][0](spark, sf)).count("Join") == 1


def test_edges_without_copies(spark, sf):
    e = T.edges(spark, sf)
    pairs = {(r.l_suppkey, r.l_partkey) for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect()}
    got = {}
    for r in sorted(e.collect(), key=lambda r: r.pos):
        got.setdefault(r.src, []).append((r.dst, r.pos))
    want = {}
    for s, p in pairs:
        want.setdefault(f"S{s}", []).append(f"P{p}")
        want.setdefault(f"P{p}", []).append(f"S{s}")
    assert got == {k: [(d, i + 1) for i, d in enumerate(sorted(v))] for k, v in want.items()}
    assert "Aggregate" not in plan(e)


def test_bridges_and_jaccard_of_repeated_pairs(spark):
    e = spark.createDataFrame([("a", "m", 2), ("a", "k", 1), ("a", "m", 3), ("m", "t", 1), ("m", "t", 2), ("k", "u", 1), ("t", "m", 1), ("t", "z", 2)], "src string, dst string, pos int")
    pairs = spark.createDataFrame([("a", "t"), ("a", "t"), ("a", "q")], "seed string, terminal string")
    for n in (None, 3):
        d = graph.bridges(e, pairs, n)
        assert [tuple(r) for r in d.collect()] == [("a", "t", "m")] and "LeftSemi" in plan(d)
        j = graph.reference_jaccard(e, pairs.toDF("a", "b"), n)
        assert sorted(map(tuple, j.collect())) == [("a", "q", 0, 0.0), ("a", "t", 1, 0.3333)]


def test_headers_are_normalised_once(spark, sf):
    """Not again for each pair, nor are the words of a claim's section."""
    assert "regexp" not in plan(catalog.QUERIES["theta_anti"][0](spark, sf)).partition("Join")[0]
    c = spark.createDataFrame([(1, 1, "a claim of 5%", "Our results")], "sample int, claim_id int, claim string, source_section string")
    s = spark.createDataFrame([(1, 1, "2. Results of ours", "5% claim")], "sample int, pos int, header string, text string")
    assert "regexp_extract_all(qn" not in plan(bundle.verify_claims(c, s)).partition("LocalRelation")[0].partition("Join Inner")[0]


def test_context_type_is_worked_out_once(spark):
    t = spark.createDataFrame([("no",), (None,), ("we improve on it",), ("unlike and superior, we improve on it",)], "t string").repartition(2).select("t", X.context_type(F.col("t")).alias("kind"))
    assert {r.t: r.kind for r in t.collect()} == {"no": "unclassified", None: "unclassified", "we improve on it": "limitation_resolution", "unlike and superior, we improve on it": "comparison"}
    assert plan(t).upper().count("RLIKE") == sum(map(len, X.CONTEXT_TYPES.values()))
