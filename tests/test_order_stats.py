import math
import random

import pytest

from quillgraph.functions import numbers

SHARES = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def truth(rows):
    by: dict = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(float(v))
    order = lambda v: (math.isnan(v), 0 if math.isnan(v) else v)
    at = lambda vs, p: sorted(vs, key=order)[min(math.floor(p * len(vs)), len(vs) - 1)]
    return sorted((str(k), len(vs), *(repr(at(vs, p)) for p in SHARES.values()), repr(min(vs, key=order)), repr(max(vs, key=order))) for k, vs in by.items())


def got(spark, rows):
    out = numbers.order_stats(spark.createDataFrame(rows, "k string, v double"), "k", "v", SHARES, ends=True)
    assert out.columns == ["k", "n", "mean", *SHARES, "min", "max"]
    return sorted((str(r.k), r.n, *(repr(r[c]) for c in SHARES), repr(r["min"]), repr(r["max"])) for r in out.collect())


def made(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice(("a", "a", "a", "b", None)), rng.choice((rng.gauss(0, 1), float(rng.randrange(5)), rng.paretovariate(0.3)))) for _ in range(n)]
    return rows + [("one", 3.5), ("same", 2.0), ("same", 2.0), ("none", None), ("big", math.inf), ("big", -math.inf), ("big", 0.0), ("nan", math.nan), ("nan", 1.0), ("nan", math.nan), ("nan", 2.0)]


def test_exact(spark):
    rows = made(1, 30_000)
    assert got(spark, rows) == truth(rows) and got(spark, []) == []


@pytest.mark.parametrize("sketch, most", [(8, 1 << 20), (4096, 20)])
def test_poor_sketches_and_large_brackets(spark, monkeypatch, sketch, most):
    """Brackets that miss their place are widened, and those with many values narrowed."""
    monkeypatch.setattr(numbers, "SKETCH", sketch)
    monkeypatch.setattr(numbers, "ERROR", 0.0001 if sketch == 8 else 0.05)
    monkeypatch.setattr(numbers, "MOST_INSIDE", most)
    rows = made(2, 4000)
    assert got(spark, rows) == truth(rows)


def test_exchanges(spark, sf, monkeypatch):
    plans = []
    keep = numbers.written
    explained = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(numbers, "written", lambda df, what: keep(explained(df), what))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    explained(numbers.order_stats(lines, "l_returnflag", "l_extendedprice", {"p50": 0.5, "p90": 0.9}))
    assert sum(p.count("Exchange hashpartitioning") for p in plans) <= 6
