import math

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import numbers, sections, text, toolcalls
from quillgraph.operators import replay


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, norm", [("Apdx_B.2: Proofs", "proofs"), ("IV-B Results", "results"), ("4.2. Method", "method"), ("civil engineering", "engineering"), ("  A:  b–c ", "a b c")])
def test_normalize_header(spark, raw, norm):
    assert one(spark, text.normalize_header(F.lit(raw))) == norm


@pytest.mark.parametrize("q, t, hit", [("", "x", False), ("x", "", False), ("Main Results", "results and main points", True), ("Alpha", "Beta", False), ("4. Method", "Our method", True)])
def test_section_match(spark, q, t, hit):
    assert one(spark, text.section_match(F.lit(q), F.lit(t))) is hit


def test_alias(spark):
    for i, a in [(0, "A"), (25, "Z"), (26, "AA"), (27, "AB"), (701, "ZZ"), (702, "AAA")]:
        assert one(spark, text.section_alias(F.lit(i))) == a and one(spark, text.alias_index(F.lit(a))) == i


def test_match_section(spark):
    s = F.array(*(F.struct(F.lit(h).alias("header"), F.lit("t").alias("text")) for h in ("1. Intro", "Results A", "Results B")))
    for q, i in [("(B)", 1), ("QA", None), ("results", None), ("results a", 1), ("intro", 0), ("", None), ("1. intro", 0)]:
        assert one(spark, sections.match_section(F.lit(q), s)) == i


def test_letters_and_counts(spark):
    for a, i in [("(b).", 1), ("B)", 1), ("B because", -1), (" d :", 3), ("", -1)]:
        assert one(spark, text.answer_index(F.lit(a))) == i
    assert one(spark, text.citations_in(F.lit("(A, 2020; B, 2021) x (C, 2019)"))) == 3 and one(spark, text.citations_in(F.lit("none"))) == 1
    assert one(spark, text.specificity(F.array().cast("array<string>"))) == 99
    assert one(spark, text.context_type(F.lit("compared with it, extends that"))) == "comparison"
    assert one(spark, text.context_type(F.lit("nothing"))) == "unclassified"
    assert one(spark, text.relation(F.array(F.lit("evolution"), F.lit("comparison")))) == "METHOD" and one(spark, text.relation(F.array().cast("array<string>"))) == "GROUND"
    assert one(spark, text.numeric_overlap(F.lit("10 20 3"), F.lit("10 30 4"))) == 0.5 and one(spark, text.numeric_overlap(F.lit("1 2"), F.lit("1 2"))) == 0


def test_rates_and_order_stats(spark):
    assert one(spark, numbers.rate(F.lit(1), F.lit(0))) == 0.0 and one(spark, numbers.rate(F.lit(1), F.lit(32))) == 0.0313
    d = spark.createDataFrame([("a", float(x)) for x in (4, 2, 1, 3)] + [("b", 5.0)] * 7 + [(None, 1.0), ("c", None)], "k string, v double")
    out = {r.k: r for r in numbers.order_stats(d, "k", "v", {"p50": 0.5, "p90": 0.9, "p95": 0.95}, cells=2).collect()}
    assert (out["a"].p50, out["a"].p90, out["a"].p95, out["a"].n) == (3, 4, 4, 4) and out["b"].p90 == 5 and out[None].p50 == 1 and "c" not in out


def simulate(calls, budget=30):
    left, ran, rejected, run, done, stop, at = budget, 0, 0, 0, False, False, -1
    for turn, tool in calls:
        if stop or (turn > at and (run >= 2 or done)):
            stop = True
            continue
        at, cost = turn, replay.TOOL_COSTS.get(tool, 0)
        if cost > left and tool != "submit_answer":
            rejected, run = rejected + 1, run + 1
        else:
            left, ran, run, done = left - cost, ran + 1, 0, done or tool == "submit_answer"
    return left, ran, rejected, run, done, stop


def test_budget_machine(spark):
    import random

    r = random.Random(1)
    tools = [*replay.TOOL_COSTS, "unknown"]
    rows = [(i, [(t // 3, r.choice(tools[:5] * 3 + tools)) for t in range(r.randrange(0, 40))]) for i in range(80)]
    d = spark.createDataFrame(rows, "i long, calls array<struct<turn:int,tool:string>>").select("i", replay.budget_machine("calls").alias("s"))
    got = {x.i: (x.s.left, x.s.ran, x.s.rejected, x.s.run, x.s.submitted, x.s.stopped) for x in d.collect()}
    assert got == {i: simulate(c) for i, c in rows}


@pytest.mark.parametrize("written, calls", [
    ('<tool_call>{"name": "think", "arguments": {"a": 1}}</tool_call>', [("think", {"a": 1})]), ('```json\n{"name": "think", "arguments": "{\\"b\\": 2}"}\n```', [("think", {"b": 2})]),
    ("```tool_code\nread_section(paper_id='p', n=3)\n```", [("read_section", {"paper_id": "p", "n": 3})]), ('<|channel|>x to=functions.think <|constrain|>json<|message|>{"q": 1}', [("think", {"q": 1})]),
    ('a {"name": "think", "arguments": {"a": "b"}} b\nthink(x=1)', [("think", {"a": "b"})]), ("think(a=\"x\")\n# think(b=1)", [("think", {"a": "x"})]), ("so [think(a=1), get_references(b='c')]", [("think", {"a": 1}), ("get_references", {"b": "c"})]), ("nope(a=1)", []), (None, []),
])
def test_tool_calls(written, calls):
    assert toolcalls.parse(written) == calls


def test_tool_calls_of_odd_texts():
    p = toolcalls.parse
    assert p(None) == p("") == p("{ ( [") == p("think(") == p('<tool_call>{"name": "think"') == p("<tool_call>[1]</tool_call>") == []
    assert p('<tool_call>{"name": "other", "arguments": {}}</tool_call>\nthink()') == [("think", {})] and p('<tool_call>{"name": "think", "arguments": "no json"}</tool_call>') == [("think", {"_raw": "no json"})]
    assert p('{"name": "think", "arguments": [1]}') == [("think", {})] and p("see [1] and [think(a='x, y)'), 3]") == [] and p("[think(a='x, y)')]") == [("think", {"a": "x, y)"})]
    assert p('{ {"name": "think", "arguments": {"a": "}"}}') == [("think", {"a": "}"})] and p('think(a="b", c=d, e=12)\n  # think(x=1)') == [("think", {"a": "b", "e": 12})]
    assert p("{" * 20_000 + "think(a=1)") == [] and p("[" * 20_000 + "\nthink(a=1)") == [("think", {"a": 1})]


def test_tool_calls_from_sql(spark):
    toolcalls.register(spark)
    t = spark.createDataFrame([(1, "think(a=1)\nread_section(p='x')"), (2, None), (3, "own(z=9)")], "i int, t string")
    got = spark.sql("SELECT i, c.* FROM {t}, LATERAL tool_calls(t) c", t=t).collect()
    assert [(r.i, r.id, r.name, r.args) for r in got] == [(1, "text_1", "think", {"a": "1"}), (1, "text_2", "read_section", {"p": "x"})]
    assert [r.name for r in spark.sql("SELECT c.* FROM {t}, LATERAL tool_calls(t, array('own')) c", t=t).collect()] == ["own"]
    for wrong in ("i", "t, 3"):
        with pytest.raises(Exception, match="tool_calls"):
            spark.sql(f"SELECT c.* FROM {{t}}, LATERAL tool_calls({wrong}) c", t=t).collect()


def test_capped_text(spark):
    s = F.array(*(F.struct(F.lit(h).alias("header"), F.lit(t).alias("text")) for h, t in [("A", "x" * 9), ("Apdx_1", "y" * 6), ("Apdx_2", "z" * 6), ("Apdx_3", "w")]))
    out = one(spark, sections.capped_text(s, 8))
    assert "x" * 9 in out and "yyyyyy" in out and "zz\n[...truncated, 4 chars omitted]" in out and "w" not in out


def test_sentence_cut(spark):
    t = "a" * 300 + ". " + "b" * 400
    assert one(spark, text.sentence_cut(F.lit(t))) == "a" * 300 + "." and one(spark, text.sentence_cut(F.lit("a" * 600))) == "a" * 500 and math.isfinite(1)
