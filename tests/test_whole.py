"""Queries that once read only a part of their tables, on tables that go beyond the former bounds."""

import pytest
from pyspark.sql import functions as F

from oracle import connect, same
from quillgraph.functions import text as X
from quillgraph.plans import catalog

LARGER = "/root/testdata/sf0.01"
WHOLE = ["answer_letter", "clean_brackets", "tool_call_texts", "section_alias", "inventory", "reply_answers", "section_match_join", "match_section", "section_orders", "fixed_chains"]


@pytest.mark.parametrize("name", WHOLE)
def test_every_row(spark, name):
    query, sql = catalog.QUERIES[name]
    same(query(spark, LARGER), connect(LARGER), sql)


def test_greedy_expand_starts_from_every_supplier(spark, sf):
    """The best ten references of each supplier, from the lines themselves."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_returnflag", "l_quantity").collect()
    edges: dict = {}
    for s, p, flag, n in lines:
        e = edges.setdefault(f"S{s}", {}).setdefault(f"P{p}", [0, 0.0, 0.0])
        e[0], e[1], e[2] = e[0] + 1, max(e[1], 10.0 * (flag == "R")), e[2] + float(n)
    want = []
    for s, own in edges.items():
        scored = [(n * 2.5 + r - 2.5, q, p) for p, (n, r, q) in own.items()]
        best = [x for x in scored if x[0] >= 3.0] or [(min(q / 100.0, 50.0), q, p) for _, q, p in scored]
        want += [(s, p) for _, _, p in sorted(best, key=lambda x: (-x[0], x[2]))[:10]]
    seeds = {f"S{r.s_suppkey}" for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()}
    got = [(r.seed, r.node) for r in catalog.QUERIES["greedy_expand"][0](spark, sf).where("depth = 1").collect()]
    assert sorted(got) == sorted(x for x in want if x[0] in seeds)


def test_alias_of_any_number(spark):
    def alias(i):
        return alias(i // 26 - 1) + chr(65 + i % 26) if i >= 26 else chr(65 + i)

    at = sorted({x for w in range(1, 7) for e in [sum(26**k for k in range(1, w + 1))] for x in (e - 1, e, e + 1)} | {0, 18278, 20000, 123456, 2**31 - 1})
    a = X.section_alias(F.col("i"))
    got = spark.createDataFrame([(i,) for i in at], "i int").select("i", a.alias("alias"), X.alias_index(a).alias("back")).collect()
    assert sorted(map(tuple, got)) == [(i, alias(i), i) for i in at]


def test_running_sums_of_sparse_and_null_orders(spark):
    """Numbers far apart, one hot key, keys that are null: sums of ranges and inside them."""
    import random

    from quillgraph.operators import access, ranges

    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(("a", None)), pos, rng.randrange(9)) for pos in rng.sample(range(-(2**60), 2**60), 3000)]
    out = ranges.running(spark.createDataFrame(rows, "k string, pos long, v int"), "k", "pos", {"s": F.col("v")}).collect()
    sums, want = {}, []
    for k, pos, v in sorted(rows, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + v
        want.append((str(k), pos, v, sums[k]))
    assert sorted((str(r.k), r.pos, r.v, r.s) for r in out) == sorted(want)
    runs = access.killed(spark.createDataFrame([(p, v) for _, p, v in rows], "pos long, tokens int"), 4000).collect()
    before, begun = 0, []
    for _, pos, v in sorted(rows, key=lambda r: r[1]):
        begun.append((pos, before < 4000))
        before += v
    assert sorted((r.pos, r.run) for r in runs) == begun


def test_listing_of_over_702_sections(spark):
    """Aliases go on with three letters."""
    from quillgraph.functions import sections as S

    s = F.transform(F.sequence(F.lit(0), F.lit(910)), lambda i: F.struct(F.lit("H").alias("header"), F.lit("ab").alias("text")))
    lines = spark.range(1).select(S.listing(s).alias("t")).head().t.split("\n")
    assert len(lines) == 911 and lines[701:704] == ["(ZZ) H [2 chars]", "(AAA) H [2 chars]", "(AAB) H [2 chars]"] and lines[910] == "(AIA) H [2 chars]"
