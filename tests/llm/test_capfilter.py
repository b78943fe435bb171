import math

import numpy as np
import pytest

from quillgraph.llm import capfilter

COLS = "vec_id long, embedding array<float>, n_links string"


def truth(rows, cosine=0.9):
    """Rows are vectors of their own, whatever their ids."""
    ok = []
    for _, v, *_ in rows:
        x = None if v is None or not len(v) or any(c is None or not math.isfinite(c) for c in v) else np.array(v, np.float32).astype(float)
        ok.append(None if x is None or not x.any() else x / np.linalg.norm(x))
    links = [[j for j, y in enumerate(ok) if i != j and x is not None and y is not None and len(x) == len(y) and x @ y >= cosine] for i, x in enumerate(ok)]
    comp: dict = {}
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for k in links[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        comp[i] = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
    return order((r[0], len(links[i]), comp[i], comp[i] == r[0]) for i, r in enumerate(rows))


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


def got(spark, rows):
    return order(map(tuple, capfilter.near_vectors(spark.createDataFrame(rows, COLS)).collect()))


def test_table(spark):
    rows = [(r.vec_id, r.embedding, None) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = truth(rows)
    assert got(spark, rows) == want


def test_odd_rows_blocks(spark, monkeypatch):
    monkeypatch.setattr(capfilter, "BLOCK", 16)
    rng = np.random.default_rng(7)
    c = rng.standard_normal((3, 24))
    rows = [(1, None, "x"), (2, [], None), (3, [0.0] * 24, None), (4, [float("nan")] + [1.0] * 23, None), (5, [None] + [1.0] * 23, None), (6, [1.0, 2.0], None), (7, [2.0, 4.0], "y"), (8, [1.0], None)]
    for i in range(120):
        rows.append((100 + i, (c[i % 3] + 0.25 * rng.standard_normal(24)).astype(np.float32).tolist(), None))
    rows += [(300 + i, c[0].tolist(), None) for i in range(5)] + [(None, c[1].tolist(), None), (100, c[2].tolist(), None), (None, (-c[2]).tolist(), None), (None, (-c[2]).tolist(), None)]
    assert got(spark, rows) == truth(rows)
    assert got(spark, []) == []


@pytest.mark.parametrize("vectors, least", [(50_000, 0.99), (500_000, 0.985), (5_000_000, 0.975)])
def test_recall_at_the_threshold(vectors, least):
    """Pairs at a cosine of just 0.9 share a filter nearly always, with as many filters as so many vectors have."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((2000, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
    code = capfilter.Code(64, capfilter.LIST * vectors // capfilter.PER_FILTER)
    hit = np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(code.decode(x), code.decode(y))])
    assert hit >= least, hit


def test_lists_are_the_highest():
    rng = np.random.default_rng(9)
    code, x = capfilter.Code(10, 900), rng.standard_normal((40, 10))
    a, b = code.scores(x)
    every = a[:, :, None] + b[:, None, :]
    for i, got_ in enumerate(code.decode(x)):
        best = np.argsort(-every[i].ravel())[: capfilter.LIST]
        assert sorted(got_.tolist()) == sorted(((best // code.size) << 20 | best % code.size).tolist())
