import re

import numpy as np
import pytest

from quillgraph.llm import minhash
from quillgraph.llm.components import components

COLS = "doc_id long, text string, n_shingles string"


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({(len(w), *w)} if w else set())


def truth(rows, k, percent=80):
    """Rows are documents of their own, whatever their ids."""
    s = [(i, shingles(t, k)) for i, (_, t, *_) in enumerate(rows)]
    up = {i: i for i, _ in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    ids = [r[0] for r in rows]
    least = {}
    for i, _ in s:
        least[root(i)] = min(filter(lambda d: d is not None, (least.get(root(i)), ids[i])), default=None)
    return order((ids[i], len(x), least[root(i)], ids[i] == least[root(i)]) for i, x in s)


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


def got(spark, rows, k):
    return order(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, COLS), k).collect()))


def test_signature_estimates_and_orders():
    rng = np.random.default_rng(3)
    for n in (3, 40, 2000):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[: n * 2 // 3], rng.integers(0, 2**63, n - n * 2 // 3, dtype=np.uint64)])
        sig = minhash.super_minhash([np.unique(x), np.unique(y), np.unique(x)], 200)
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert (sig[0] == sig[2]).all() and np.isfinite(sig).all() and abs((sig[0] == sig[1]).mean() - j) < 0.13


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, None) for r in docs.collect()]
    assert got(spark, rows, 4) == truth(rows, 4)


def test_odd_rows_and_large_groups(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(4000)]
    base = list(rng.choice(words, 60))
    rows = [(1, None, "x"), (2, "", "x"), (3, "one two", None), (4, "ONE  two", None), (5, "one two three", None), (6, " \n\t", "")]
    for i in range(60):  # a large group of near copies, some too far from most
        t = list(base)
        for p in rng.choice(60, rng.integers(0, 5), replace=False):
            t[p] = f"x{i}"
        rows.append((100 + i, " ".join(t), None))
    rows += [(300, " ".join(base), None)] * 3 + [(400, " ".join(words * 3), None)]
    assert got(spark, rows, 5) == truth(rows, 5)
    assert got(spark, [], 5) == []


def test_rows_without_an_id_and_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(4000)]
    a, b, c, d = (list(rng.choice(words, 60)) for _ in range(4))
    near = lambda t, i: " ".join([*t[:-1], f"x{i}"])
    rows = [(None, near(a, 1), "x"), (7, near(a, 2), None), (None, near(b, 1), None), (None, near(b, 2), None), (9, near(c, 1), None), (9, near(d, 1), None), (4, near(d, 2), None), (None, None, None), (3, near(c, 3), "")]
    rows += [(50 + i, near(a, 10 + i // 2), None) for i in range(40)] + [(200 + i, " ".join([*a[: 50 - i], *b[: 10 + i]]), None) for i in range(12)]
    rows += [(300, near(a, 3).upper(), None), (301, "  ".join(near(a, 3).split()), None)]  # other texts, equal sets
    assert got(spark, rows, 4) == truth(rows, 4)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "SHARD_BYTES", 2000)
    assert got(spark, rows, 4) == truth(rows, 4)
    kinds = "doc_id long, text string, `row` string, rid string, `key` string, first string, n_shingles string"
    docs = spark.createDataFrame([(*r[:2], *"abcde") for r in rows], kinds)
    kept = minhash.deduplicated(docs, 4)
    assert kept.columns == docs.columns
    out, want = kept.collect(), truth(rows, 4)
    assert {r.doc_id for r in out if r.doc_id is not None} == {r[2] for r in want if r[2] is not None} and all(r["row"] == "a" for r in out)
    assert sum(r.doc_id is None for r in out) == 2  # the empty one and one of the pair without ids


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(50)], [(0, i) for i in range(1, 40)] + [(70, 71), (71, 71)], [(9, 9)], []])
def test_components(spark, edges):
    groups: list[set] = []
    for a, b in edges:
        if a != b:
            near = [g for g in groups if a in g or b in g]
            groups = [g for g in groups if g not in near] + [set().union({a, b}, *near)]
    want = sorted((n, min(g)) for g in groups for n in g)
    assert sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == want
