import hashlib
from collections import Counter

import numpy as np

from quillgraph.llm import substring
from quillgraph.llm.fmindex import FMIndex


def test_matching_statistics():
    rng = np.random.default_rng(5)
    for _ in range(30):
        strings = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(rng.integers(1, 8))]
        weights = rng.integers(1, 3, len(strings))
        ix = FMIndex(strings, weights)
        text = [s.tolist() for s in strings]
        count = lambda x: sum(w for s, w in zip(text, weights) for i in range(len(s) - len(x) + 1) if s[i : i + len(x)] == x)
        for q, got in zip(text, ix.matching(strings)):
            want = [max([n for n in range(len(q) - p + 1) if n == 0 or count(q[p : p + n]) >= 2]) for p in range(len(q))]
            assert got.tolist() == want


COLS = "doc_id long, text string, kept string"


def truth(rows, window):
    words = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in words:
        hit = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                hit[i : i + window] = [True] * window
        kept = b" ".join(x for x, y in zip(w, hit) if not y)
        out.append((d, len(w), sum(hit), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out)


def got(spark, rows, window=35):
    return sorted(map(tuple, substring.removed(spark.createDataFrame(rows, COLS), window).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()))


def test_tables(spark, sf):
    docs = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = truth(docs, 35)
    assert sum(x[2] for x in want) > 1000 and got(spark, docs) == want


def test_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    w = [f"w{i}" for i in range(300)]
    base = list(rng.choice(w, 200))
    rows = [(1, None, "x"), (2, "", None), (3, "a b", "x"), (4, "same " * 40, ""), (5, "same " * 34, ""), (6, "same " * 30000, ""), (7, " ".join(base), ""), (7, " ".join(base), ""), (8, "ab " * 20 + "cd " * 20, "")]
    for i in range(40):
        a = rng.integers(0, 120)
        rows.append((100 + i, " ".join([*rng.choice(w, 20), *base[a : a + rng.integers(30, 60)], *rng.choice(w, 20)]), None))
    assert got(spark, rows) == truth(rows, 35)
    assert got(spark, []) == []
    monkeypatch.setattr(substring, "HOT", 3)  # most anchors take the other way
    assert got(spark, rows) == truth(rows, 35)


def test_rows_without_an_id(spark, monkeypatch):
    rng = np.random.default_rng(8)
    w = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(w, n))
    shared, copied = text(50), text(60)
    rows = [(None, f"{text(40)} {shared} {text(5)}", ""), (1, f"{text(7)} {shared} {text(30)}", ""), (None, text(80), ""), (None, None, ""), (None, "a b", "")]
    rows += [(None, copied, ""), (None, copied, ""), (2**60 + 1, f"{copied} {text(9)}", "")]
    key = lambda x: (str(x[0]), x[1:])

    def whole():
        out = substring.removed(spark.createDataFrame(rows, COLS)).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()
        return sorted(map(tuple, out), key=key)

    named = [(i, t, "") for i, (_, t, _) in enumerate(rows)]
    want = sorted(((rows[i][0], *x) for i, *x in truth(named, 35)), key=key)
    assert sum(x[2] > 0 for x in want) == 5 and whole() == want
    monkeypatch.setattr(substring, "HOT", 1)
    assert whole() == want


def test_repeated_ids_with_other_texts_and_clashing_names(spark):
    rng = np.random.default_rng(9)
    w = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(w, n))
    shared = text(50)
    rows = [(7, f"{text(9)} {shared} {text(8)}", "s"), (7, f"{shared} {text(30)}", "t"), (7, text(60), "u"), (8, text(60), "v")]
    assert got(spark, rows) == truth(rows, 35)
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, spans string, _text_key string, _spans string")
    out = substring.removed(docs)
    assert out.columns == [*docs.columns, "n_words", "n_removed", "kept_sha256", "kept"]
    assert sorted((r.spans, r.n_removed) for r in out.collect()) == [("s", 50), ("t", 50), ("u", 0), ("v", 0)]


def test_the_index_decides(monkeypatch):
    """With matching statistics that are wrong, the words that go are others, for either kind of anchor."""
    import pyarrow as pa

    from quillgraph.llm.words import text_column

    rng = np.random.default_rng(10)
    w = [f"w{i}" for i in range(2000)]
    shared = list(rng.choice(w, 60))
    texts = [" ".join([*rng.choice(w, 40), *shared[: 40 + i], *rng.choice(w, 40)]) for i in range(8)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    data, off = text_column(batch, "text")
    ids = np.arange(8)

    def covered(hot):
        anchor = next(iter(substring._anchor_rows(35, 12)(iter([pa.RecordBatch.from_arrays([pa.array(texts), pa.array(ids)], ["text", "doc_id"])]))))
        n = Counter(anchor.column(0).to_pylist())
        at: list[list[int]] = [[] for _ in ids]
        for a, d, x in zip(*(c.to_pylist() for c in anchor.columns)):
            if n[a] > 1:
                at[d].append(x)
        full = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts), pa.array(np.ones(8, np.int64)), pa.array(at, pa.list_(pa.int32()))], ["doc_id", "text", "copies", "hot" if hot else "cold"])
        sent = pa.Table.from_batches(substring._send(35, 12, "hot" if hot else "cold")(iter([full])))
        if hot:
            begun = Counter(sent.column("begin").to_pylist())
            rows = [r for r in sent.to_pylist() if begun[r["begin"]] > 1]
            one = {r["window"]: r for r in rows}
            weight = Counter(r["window"] for r in rows)
            asked: list[list[dict]] = [[{"at": r["at"], "window": r["window"], "copies": weight[r["window"]]} for r in one.values() if r["doc_id"] == d] for d in ids]
            kind = pa.list_(pa.struct([("at", pa.int32()), ("window", pa.int64()), ("copies", pa.int64())]))
            again = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts), pa.array(np.ones(8, np.int64)), pa.array(asked, kind)], ["doc_id", "text", "copies", "again"])
            found = set(substring._search(35)(pa.Table.from_batches(substring._send(35, 12, "again")(iter([again])))).column("doc_id").to_pylist())
            return {(r["doc_id"], x) for r in rows if r["window"] in found for x in range(r["at"], r["at"] + 35)}
        return {(d, x) for d, a, b in zip(*(substring._search(35)(sent).column(c).to_pylist() for c in ("doc_id", "a", "b"))) for x in range(a, b)}

    want = {(i, x) for i, n, gone, *_ in truth([(i, t) for i, t in enumerate(texts)], 35) for x in range(40, 40 + gone)}
    assert covered(False) == want and covered(True) == want
    matching = FMIndex.matching
    for wrong in (lambda self, q: [np.arange(len(x), 0, -1) for x in q], lambda self, q: [m - 1 for m in matching(self, q)]):
        monkeypatch.setattr(FMIndex, "matching", wrong)
        assert covered(False) != want and covered(True) != want
