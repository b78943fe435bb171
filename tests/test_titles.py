import random

import pytest

from quillgraph.operators import joins


def truth(queries, titles, most=40):
    norm = lambda s: None if s is None else s.strip(" ").lower()
    ts = sorted((p, norm(s), t) for t, p, s in titles if s is not None)
    out = []
    for qid, s in queries:
        q = norm(s)
        exact = next(((t, 0) for _, n, t in ts if q and n == q), None)
        out.append((qid, *(exact or next(((t, 1) for _, n, t in ts if q and q[:most] in n), (None, None)))))
    return sorted(out, key=str)


@pytest.mark.parametrize("heads", [50_000, 7])
def test_equals_brute_force(spark, monkeypatch, heads):
    monkeypatch.setattr(joins, "HEADS", heads)
    rng = random.Random(heads)
    text = lambda n: "".join(rng.choice("ab é\n.*") for _ in range(n))
    titles = [(f"t{i}", i, text(rng.choice((0, 3, 10, 60, 90)))) for i in range(200)] + [("null", 200, None), ("one", 201, "x" * 3000 + "needle in it"), ("two", 202, " Needle in IT ")]
    some = [t[2] for t in titles if t[2]]
    queries = [(i, rng.choice(some)[rng.randrange(6) :][: rng.choice((1, 2, 9, 45))]) for i in range(150)] + [(900, None), (901, ""), (902, "  "), (903, "no such title"), (904, "needle in it"), (905, "needle i"), (906, "a")]
    queries += [(1000 + i, f"{t.upper()}  ") for i, t in enumerate(some[:20])] + [(1100, some[-3][:40] + " goes on differently after forty")]
    got = joins.first_title(spark.createDataFrame(queries, "qid long, title string"), spark.createDataFrame(titles, "tid string, pos int, title string"))
    assert sorted((tuple(r) for r in got.select("qid", "tid", "rank").collect()), key=str) == truth(queries, titles)


def test_no_rows_and_no_nested_loop(spark, capsys):
    q, t = spark.createDataFrame([(1, "a")], "qid long, title string"), spark.createDataFrame([], "tid string, pos int, title string")
    out = joins.first_title(q, t)
    assert [(r.qid, r.tid) for r in out.collect()] == [(1, None)]
    out.explain()
    assert "NestedLoop" not in capsys.readouterr().out
    assert joins.first_title(q.limit(0), t).count() == 0


def test_prefixes_of_any_length(spark):
    dim = spark.createDataFrame([(0, "m"), (1, "m" * 300)], "ord int, prefix string")
    rows = spark.createDataFrame([("m" * 400,), ("m" * 200,), ("x",)], "m string")
    assert {r.m: r.ord for r in joins.prefix_join(rows, "m", dim).collect()} == {"m" * 400: 1, "m" * 200: 0, "x": None}
