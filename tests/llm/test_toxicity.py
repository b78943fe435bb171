import re

import numpy as np
import pyarrow as pa

from quillgraph.llm import toxicity as X
from quillgraph.llm.words import hash_words, mix, slices, text_column


def test_gradients():
    rng = np.random.default_rng(0)
    net = X.Network(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((6, 5, X.INPUTS))
    mask = (np.arange(6)[:, None] < np.array([6, 3, 1, 0, 5])).astype(float)
    y, w = np.array([1, 0, 1, 0, 1.0]), np.array([1, 2, 1, 1, 3.0])
    g, dx, _ = net.gradients(x, mask, y, w)
    for name, where in [*((k, net.p[k]) for k in g), ("x", x)]:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in where.shape)
            old, both = where[at], []
            for d in (1e-3, -1e-3):
                where[at] = old + d
                both.append(net.gradients(x, mask, y, w)[2])
            where[at] = old
            assert abs((both[0] - both[1]) / 2e-3 - (dx if name == "x" else g[name])[at]) < 1e-4


def test_core_words_and_windows():
    rows = ["  !!Stupïd,$$$ x ... 'Q'", "", None, "a b"]
    data, off = text_column(pa.RecordBatch.from_pydict({"text": pa.array(rows, pa.string())}), "text")
    b, a, z, h, first = X.core_words(data, off, 0, 4)
    assert [bytes(b[i:j]).decode() for i, j in zip(a, z)] == ["stupïd", "x", "", "q", "a", "b"] and first.tolist() == [0, 4, 4, 4, 6]
    row, start, n = X.windows_of(np.array([0, 100, 100, 132, 165]))
    for r, (p, q) in enumerate(((0, 100), (100, 100), (100, 132), (132, 165))):
        own = row == r
        assert start[own][0] == p and (start + n)[own][-1] == q and (np.diff(start[own]) == X.STEP).all() and (n <= X.WINDOW).all()


def test_held_out_accuracy(spark):
    """On held-out labelled rows of a test table."""
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    out = X.toxicity(docs.select("doc_id", "text"), labels).where("held_out").join(labels, "doc_id").toPandas()
    hit, bad = out[out.toxic == 1].predicted.mean(), out[out.toxic == 0].predicted.mean()
    assert hit > 0.85 and bad < 0.03, (hit, bad)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a " * 40000, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (2, 0), (2, 1), (9, 1), (None, 1)], "doc_id long, toxic int")
    out = X.toxicity(docs, labels).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert X.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_slices_do_not_matter():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["good", "nice", "words", "awful1", "text", "more"], 60)) if i % 2 else " ".join(rng.choice(["good", "nice", "words", "text"], 60)) for i in range(80)]
    net = X.train(texts, np.arange(80) % 2, rounds=2)
    data, off = text_column(pa.RecordBatch.from_pydict({"text": texts}), "text")
    whole = X.Scorer(net).score(data, off, 0, 80)
    small = np.concatenate([X.Scorer(net).score(data, off, i, j) for i, j in slices(off, 700)])
    assert np.allclose(whole, small, atol=1e-5)


def plain_score(net, text):
    """A text's score from the definition: one word, one gate and one window at a time."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, X.HIDDEN
    known = dict(zip(net.word_odds[0].tolist(), net.word_odds[1].tolist()))
    grams = {n: dict(zip(k.tolist(), v.tolist())) for n, (k, v) in net.gram_odds.items()}
    words = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        w = re.sub(rb"^[\x00-/:-@\[-`{-\x7f]+|[\x00-/:-@\[-`{-\x7f]+$", b"", bytes(c + 32 if 65 <= c <= 90 else c for c in w))
        key = int(hash_words(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) >> 1 if w else 0
        odds = [grams.get(n, {}).get(int.from_bytes((b"\1" + w + b"\2")[i : i + n], "big"), 0) for n in range(3, 9) for i in range(len(w) + 3 - n)]
        m = b"\0" + w + b"\0\0"
        rows = [int(mix(np.array([int.from_bytes(m[i : i + 3], "little")], np.uint64))[0]) % X.GRAMS for i in range(max(1, len(w)))]
        words.append(np.concatenate([[known.get(key, 0), sum(odds) / 4, max([0, *odds])], p["word"][key % X.BUCKETS], p["gram"][rows].mean(axis=0)]))
    best, at = -np.inf, 0
    while True:
        window, states = words[at : at + X.WINDOW], {}
        for s in "fb":
            now, states[s] = np.zeros(h), []
            for x in window if s == "f" else window[::-1]:
                term, u = x @ p[f"W{s}"] + p[f"c{s}"], now @ p[f"U{s}"]
                z, r = sig(term[:h] + u[:h]), sig(term[h : 2 * h] + u[h : 2 * h])
                now = z * now + (1 - z) * np.tanh(term[2 * h :] + r * u[2 * h :])
                states[s].append(now)
        both = [np.concatenate(q) for q in zip(states["f"], states["b"][::-1])]
        heed = np.exp([float((np.tanh(q @ p["A"]) @ p["v"])[0]) for q in both])
        pooled = sum((a * q for a, q in zip(heed, both)), np.zeros(2 * h)) / max(heed.sum(), 1e-9)
        best = max(best, float(pooled @ p["o"][:, 0] + p["k"][0]))
        if at + X.WINDOW >= len(words):
            return sig(best * net.slope + net.shift)
        at += X.STEP


def test_equals_definition():
    rng = np.random.default_rng(2)
    bad = ["awful1", "stüpid", "Stupidest", "awfully"]
    kind = ["good", "nice", "words", "text", "mürbe", "x", "a-b", "'it's'", "..."]
    texts = [" ".join(rng.choice(kind + bad * (i // 2 % 2), rng.integers(1, 120))) for i in range(120)]
    net = X.train(texts, np.arange(120) // 2 % 2, rounds=3)
    assert len(net.word_odds[0]) and sum(len(k) for k, _ in net.gram_odds.values())
    rows = texts[:20] + ["", "  ", "...", "!! ?", "AWFUL1!", "awful1 " * 33, "new unseen wörds, stupidity " * 30]
    data, off = text_column(pa.RecordBatch.from_pydict({"text": rows}), "text")
    got = X.Scorer(net).score(data, off, 0, len(rows))
    want = [plain_score(net, t) for t in rows]
    assert np.allclose(got, want, atol=1e-4) and np.ptp(want) > 0.2


def test_trained_in_a_task(spark, monkeypatch):
    """The driver sees neither the sample nor its training."""
    monkeypatch.setattr(X, "train", None)
    docs = spark.createDataFrame([(i, "awful stuff" if i % 2 else "good words") for i in range(40)], "doc_id long, text string")
    out = X.toxicity(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")).collect()
    assert len(out) == 40 and all(0 <= r.score <= 1 for r in out)
