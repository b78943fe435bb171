import hashlib
import re

from quillgraph.llm import infill

COLS = "doc_id long, text string, form string, ends string, `_ends` string, N string"
TEXTS = [
    None, "", " ", "a", "<", "one two", "x<P>y", "a<S>", "<M>", "<P", "S>", "<<P>>", "a<", "<S<M", "é è\n\n ü", "tab\tand\r\nlines\n", "\x01", "\x02", "\x01\x02\x02\x01a\x020b\x021",
    "emoji 😀 in 👩‍👩‍👧 words", "日本語 text ١٢", "$0 \\1 $", "\0 nul \0", "a b\x85c", "word, " * 30000, "<" * 500, "P>S>M>" * 50, ">" * 9 + "<" * 9,
]


def truth(doc_id, text):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    if h4 % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_definition(spark):
    rows = [(i * 31 + k if i else None, t, "f", "e", "_e", "big n") for k, t in enumerate(TEXTS) for i in range(9)]
    rows += rows[:20]
    out = infill.infilled(spark.createDataFrame(rows, COLS))
    assert {c.lower() for c in out.columns} == {"doc_id", "text", "ends", "_ends", "n", "form", "prefix_chars", "middle_chars", "output", "restored"}
    got = out.collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == truth(r.doc_id, r.text), (r.doc_id, r.text[:50])
        assert r.restored == (r.text or "") and r.ends == "e" and r["_ends"] == "_e"


def test_no_rows_and_no_shuffle(spark, capsys):
    out = infill.infilled(spark.createDataFrame([], COLS))
    assert out.count() == 0
    out.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan


def test_other_shares(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('some words ', id) AS text")
    forms = {r.form: r["count"] for r in infill.infilled(docs, seed="x", plain=50, spm=100).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "spm"} and 100 < forms["plain"] < 200
