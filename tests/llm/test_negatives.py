import numpy as np
import pytest

from quillgraph.llm import negatives

COLS = "vec_id long, label int, vector array<long>, anchor boolean, g string, norm string"


def truth(rows, positives=5, negatives_=5, low=80, high=100):
    ok = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    ident = lambda r: (r[0] is None, r[0] or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for i, a in enumerate(ok):
        if not a[3]:
            continue
        scored = sorted(((dot(a, c), c) for j, c in enumerate(ok) if i != j), key=lambda x: (-x[0], ident(x[1])))
        for ps, p in [x for x in scored if x[1][1] == a[1]][:positives]:
            hits = [x for x in scored if x[1][1] != a[1] and low * ps <= 100 * x[0] <= high * ps]
            out += [(a[0], p[0], k + 1, c[0], ps, ns) for k, (ns, c) in enumerate(hits[:negatives_])]
    return sorted(out, key=str)


def got(spark, rows, **options):
    return sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(rows, COLS), **options).collect()), key=str)


def vectors(n, seed, spread):
    """Norms over several orders of size, labels of which one holds a third, copies."""
    rng = np.random.default_rng(seed)
    v = rng.normal(20, 60, (n, 16)) * np.exp(rng.normal(0, spread, n))[:, None]
    v[n // 2 : n // 2 + n // 6] = v[0]
    label = np.where(rng.random(n) < 0.3, 0, rng.integers(0, 6, n))
    return [(i, int(x), np.floor(y).astype(int).tolist(), i % 9 == 0, "g", "norm") for i, (x, y) in enumerate(zip(label, v))]


@pytest.mark.parametrize("spread", [0, 1.5])
def test_equals_brute_force(spark, monkeypatch, spread):
    for what, n in (("BUCKET", 16), ("BLOCK", 8), ("GROUP", 60)):
        monkeypatch.setattr(negatives, what, n)
    rows = vectors(400, 5, spread)
    assert got(spark, rows) == truth(rows)
    assert got(spark, rows, positives=2, negatives=7, low=20, high=90) == truth(rows, 2, 7, 20, 90)


def test_buckets_are_passed_over(spark, monkeypatch):
    """With norms that differ, most products are never worked out; results stay whole."""
    for what, n in (("BUCKET", 16), ("BLOCK", 8), ("GROUP", 4000)):
        monkeypatch.setattr(negatives, what, n)
    base = vectors(400, 6, 1.5)
    blocks = []
    products = negatives._products
    monkeypatch.setattr(negatives, "_products", lambda a, c, t: blocks.append(len(a) * len(c)) or products(a, c, t))
    x = [negatives.pack(**{"r": np.array([r[0] for r in part]), "id": np.array([r[0] for r in part]), "label": np.array([r[1] for r in part]), "norm": np.array([float(np.linalg.norm(r[2])) for r in part]), "need": np.full(len(part), -np.inf), "v": np.array([r[2] for r in part])}) for part in _parts(sorted(base, key=lambda r: -np.linalg.norm(r[2])), 16)]
    rows = [(0, 0, 0, negatives_unpack(x[3])), *((0, 1, i, negatives_unpack(d)) for i, d in enumerate(x))]
    found = list(negatives._tile(5, 80, 100)(iter(rows)))
    assert sum(b.num_rows for b in found) > 40 and sum(blocks) < 0.6 * 16 * 400


def _parts(rows, n):
    return [rows[i : i + n] for i in range(0, len(rows), n)]


def negatives_unpack(data):
    from quillgraph.packed import unpack

    return unpack(data)


def test_odd_rows(spark):
    big = 2**30
    rows = [
        (0, 1, [3, 4], True, "", ""), (7, 1, [3, 4], False, "", ""), (7, 1, [3, 4], True, "", ""), (None, 1, [3, 4], False, "", ""), (None, 2, [3, 4], True, "", ""), (5, 2, [3], False, "", ""), (6, 2, [], False, "", ""),
        (8, 2, [0, 0, 9], True, "", ""), (9, None, [3, 4], True, "", ""), (10, 2, None, True, "", ""), (11, 2, [1, None], True, "", ""), (12, 3, [-3, -4], True, "", ""), (13, 3, [3, 4], None, "", ""), (14, 3, [2, 4, 7], True, "", ""),
    ]
    assert got(spark, rows) == truth(rows) != []
    huge = [(i, i % 2, [big + i, big - i, 3], i % 3 == 0, "", "") for i in range(12)]
    assert got(spark, huge) == truth(huge) != []
    assert got(spark, []) == [] and got(spark, [(1, 1, [1], False, "", "")]) == [] and got(spark, [(1, 1, [1], True, "", "")]) == []


def test_quantized(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([1.0, None],), ([float("nan")],), ([float("inf")],), ([float("-inf")],), (None,), ([],)], "e array<float>")
    assert [r[0] for r in df.select(negatives.quantized("e", 256)).collect()] == [[128, -1], None, None, None, None, None, []]
