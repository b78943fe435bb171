import random

import pytest

from quillgraph.operators import search


def truth(queries, docs, k):
    out = []
    for qid, toks in queries:
        want = {t for t in toks or () if t is not None}
        hits = [(len(want & set(d[2] or ())), d[1], d[0]) for d in docs]
        best = sorted((h for h in hits if h[0]), key=lambda h: (-h[0], h[1], h[2]))[:k]
        out += [(qid, d, p, n, i + 1) for i, (n, p, d) in enumerate(best)]
    return sorted(out)


def made(seed, docs, queries):
    rng = random.Random(seed)
    draw = lambda n: [f"w{int(rng.paretovariate(0.4)) % 300}" for _ in range(n)]
    d = [(f"d{i % (docs - 5)}", i // 3, draw(rng.choice((0, 3, 30, 200)))) for i in range(docs)]
    d += [("null", 1, None), ("odd", 2, [None, "w1", "w1"]), ("long", 3, draw(20_000))]
    return [(i, draw(rng.choice((1, 5, 40)))) for i in range(queries)] + [(900, []), (901, None), (902, ["not there"]), (903, [None, "w1", "w1"])], d


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_both_plans_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(search, "MOST_TOKENS", most)
    monkeypatch.setattr(search, "BLOCK", 7)
    for seed, k in ((1, 5), (2, 1), (3, 10)):
        q, d = made(seed, 300, 30)
        got = search.token_overlap_search(spark.createDataFrame(q, "qid long, tokens array<string>"), spark.createDataFrame(d, "doc string, pos int, tokens array<string>").repartition(3), k)
        assert sorted(map(tuple, got.collect())) == truth(q, d, k)
    none = spark.createDataFrame([], "doc string, pos int, tokens array<string>")
    assert search.token_overlap_search(spark.createDataFrame(q, "qid long, tokens array<string>"), none).count() == 0
    assert search.token_overlap_search(spark.createDataFrame([], "qid long, tokens array<string>"), spark.createDataFrame(d, "doc string, pos int, tokens array<string>")).count() == 0


def test_blocks_that_cannot_reach_the_best_are_passed_over(monkeypatch):
    import numpy as np
    import pyarrow as pa

    q, d = made(4, 2000, 20)
    d.sort(key=lambda x: -len(set(x[2] or ())))
    words = sorted({t for x in q for t in x[1] or () if t})
    lists = [[i for i, x in enumerate(q) if w in (x[1] or ())] for w in words]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    met = []
    spread = search._spread
    monkeypatch.setattr(search, "_spread", lambda f, t: met.append(len(r := spread(f, t)[0]) if len(np.unique(t)) < len(t) else 0) or spread(f, t))
    run = search._scan(pa.array(words), first, np.array([i for x in lists for i in x]), pa.array([x[0] for x in q]), 5)
    cols = lambda part: pa.RecordBatch.from_arrays([pa.array([x[0] for x in part]), pa.array([x[1] for x in part]), pa.array([x[2] for x in part], pa.list_(pa.string()))], ["doc", "pos", "tokens"])
    rows = [r for b in run(iter([cols(d[i : i + 500]) for i in range(0, len(d), 500)])) for r in b.to_pylist()]
    assert sorted((r["qid"], r["overlap"]) for r in rows) == sorted((t[0], t[3]) for t in truth(q, d, 5))
    every = sum(len(set(x[2] or ()) & set(words)) for x in d)
    assert len(rows) <= 5 * len(q) and len([m for m in met if m]) < len(d) // search.BLOCK
    assert every
