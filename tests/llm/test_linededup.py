import hashlib
from collections import Counter

import numpy as np

from quillgraph.llm import linededup
from quillgraph.llm.perfecthash import PerfectHash

COLS = "doc_id long, text string, kept string, I string, gone int"
SPACE = " \t\n\x0b\x0c\r"
UP = {c: c + 32 for c in range(65, 91)}


def truth(rows, least=5, shortest=40):
    keys = [[x.strip(SPACE).translate(UP) for x in (t or "").split("\n")] for _, t, *_ in rows]
    low = [-(2**63) if r[0] is None else r[0] for r in rows]
    n, last = Counter(), {}
    for d, ks in zip(low, keys):
        for k in {k for k in ks if len(k) >= shortest}:
            n[k] += 1
            last[k] = max(last.get(k, d), d)
    out = []
    for (i, t, *_), d, ks in zip(rows, low, keys):
        kept = [x for x, k in zip((t or "").split("\n"), ks) if not (n[k] >= least and d < last[k])]
        out.append((i, len(ks), len(ks) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=str)


def same(spark, rows, **options):
    out = linededup.deduplicated(spark.createDataFrame(rows, COLS), **options)
    got = out.collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256, r.kept) for r in got), key=str) == truth(rows, **options)
    assert all(r.I == "i" and r["gone"] == 7 for r in got)
    return got


def docs(spark, sf):
    return [(r.doc_id, r.text, "clash", "i", 7) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 40_000):
        hi, lo = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
        lo[: n // 2] = lo[:1]  # halves may be equal, pairs are distinct
        h = PerfectHash.of(hi, lo)
        assert sorted(h.numbers(hi, lo).tolist()) == list(range(n)) and 64 * len(h.bits) <= 5 * n + 64 * 30
        other = h.numbers(*rng.integers(0, 2**64, (2, 100), dtype=np.uint64))
        assert ((other >= -1) & (other < max(1, n))).all()


def test_table_in_many_chunks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 5)
    rows = docs(spark, "/root/testdata/sf0.01")
    got = same(spark, rows)
    assert sum(r.n_dropped for r in got) > 100
    same(spark, rows[:200], least=2, shortest=10)


def test_the_count_array_decides(spark, sf, monkeypatch):
    """Lines of two to four documents are in the index; only their counts keep them."""
    rows = docs(spark, "/root/testdata/sf0.01")
    probe = linededup._probe
    monkeypatch.setattr(linededup, "_probe", lambda least: probe(2))
    out = linededup.deduplicated(spark.createDataFrame(rows, COLS), texts=False)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sum(r.n_dropped for r in out.collect()) > sum(t[2] for t in truth(rows))


def test_odd_rows(spark):
    a, b, e = "A line of well over forty characters, in many texts", "b" * 39, "é" * 40
    c, d = "c" * 40, "DÀ" * 20
    rest = ("x", "i", 7)
    rows = [(i, f"  {a.upper() if i % 2 else a}\t\n{b}\n{e}\r\n{c}", *rest) for i in range(4)]
    rows += [(9, f"{a}\n\n{a}", *rest), (9, a, *rest), (7, f"{d}\n{c}\n{c}", *rest), (7, f"{d}\n{c}\n{c}", *rest)]
    rows += [(None, f"{d.lower()}\n{e}\nend", *rest)] * 3 + [(None, None, *rest), (20, "", *rest), (21, "\n\n", *rest), (-5, f"{'é' * 20}\x85{a}\x0b", *rest)]
    rows += [(None, "z" * 50, *rest)] * 6 + [(30, "\n".join([a] * 20_000 + ["tail"]), *rest), (31, ("w" * 100_000) + "\n" + a, *rest)]
    got = same(spark, rows)
    by = {r.doc_id: r for r in got}
    assert by[30].n_dropped == 20_000 and by[31].n_dropped == 0 and by[20].n_lines == 1 and sum(r.n_dropped for r in got if r.kept == "z" * 50) == 0
    assert linededup.deduplicated(spark.createDataFrame([], COLS)).count() == 0
    same(spark, [(1, "short", *rest)])


def test_rows_without_an_id_share_a_line(spark):
    line = "the same line of more than forty characters everywhere"
    rows = [(None if i % 2 else i, f"{line}\nown {i % 7}", "x", "i", 7) for i in range(40)]
    assert sum(r.n_dropped for r in same(spark, rows)) == 39
