import random

import paper_tree
from quillgraph.session import bucketed
from quillgraph.sources import papers

PAGE = """<html><body><section><h2>1 Intro</h2><p>Hello <math>x<annotation>raw</annotation></math> world.</p><section><h3>References</h3><p>gone</p></section></section>
<section><h2>Appendix A Proofs</h2><p>proof</p></section><section><h2>A.1Title</h2><p>t</p></section><section><h2>References</h2><p>r</p></section>
<figure class="ltx_table"><figcaption class="ltx_caption">Cap</figcaption><table><tr><th>a</th><td>b</td></tr></table></figure></body></html>"""
WORDS = ["one", "two ", " three", "a &amp; b", "&lt;x&gt;", "&copy 5", "&#8217;", "&#x1F600;", "&#150;", "&unknown;", "&amp", "1 < 2", "a\n b", "\u00a0", "x<!-- c -->y", "&notin;", "&notit;", "<3", "50% &", "&ampx", "&#0;", "&#99999999;"]
HEADERS = ["1. Intro", "IV-B Results", "References", "Appendix A Proofs", "Appendix: More", "A.1Title", "IIntroduction", "CLIP Training", "S.2 Extra", "Our Paper Checklist", "Supplementary 0.B Data", "Ethics", "3.2 ", ""]


def made(rng, depth=0):
    """Nested elements: all closed but p, li and br, whose ends may be missing."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        k = rng.randrange(12)
        if k < 4 or depth > 3:
            out.append(rng.choice(WORDS))
        elif k < 7:
            h = rng.choice(("h2", "h2", "h3", "h4"))
            head = f"<{h} class=x>{rng.choice(HEADERS)}</{h}>" if rng.random() < 0.8 else ""
            out.append(f"<section id='a>b'>{head}{made(rng, depth + 1)}</section>" if rng.random() < 0.6 else f"{head}<div>{made(rng, depth + 1)}</div>")
        elif k == 7:
            out.append(f"<ul>{''.join(f'<li>{rng.choice(WORDS)}' for _ in range(3))}</ul>" if rng.random() < 0.5 else f"<div><p>{rng.choice(WORDS)}<p>{rng.choice(WORDS)}</div>")
        elif k == 8:
            out.append(rng.choice(("<br>", "<img src=x/>", "<script>if (a < b) '</p>'</script>", "<style>p > a {}</style>", "<!-- <section> -->", "<b/>", "</i>", "<math><annotation>z</annotation>m</math>")))
        elif k == 9:
            rows = "".join(f"<tr>{''.join(f'<t{rng.choice(chr(100) + chr(104))}>{rng.choice(WORDS)}</t{chr(100)}>' if False else f'<td>{rng.choice(WORDS)}</td>' for _ in range(rng.randrange(3)))}</tr>" for _ in range(rng.randrange(4)))
            wrap = rng.choice(("<figure class='a ltx_table'><figcaption class=\"ltx_caption\">{w}</figcaption>{t}</figure>", "{t}", "<div class=table-wrapper>{t}</div>"))
            out.append(wrap.format(w=rng.choice(WORDS), t=f"<table>{rows}</table>"))
        else:
            out.append(f"<div CLASS='c'>{made(rng, depth + 1)}</div>")
    return "".join(out)


def parsed(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id long, html string")
    return {r.id: ([s.asDict() for s in r.sections], [t.asDict() for t in r.tables]) for r in papers.parse_papers(df, "id", "html").collect()}


def test_fixtures(spark):
    heads = ["CLIP Training", "Appendix: Additional", "IIntroduction"]
    got = parsed(spark, [PAGE, "<h1>2. X</h1><p>a</p><div>b</div><h2>Acknowledgments</h2><p>c</p>", "".join(f"<section><h2>{h}</h2>t</section>" for h in heads), None, ""])
    assert got[0] == ([{"header": "Intro", "text": "Hello x world."}, {"header": "Apdx_A: Proofs", "text": "proof"}, {"header": "Apdx_A.1: Title", "text": "t"}], [{"caption": "Cap", "rows": [["a", "b"]]}])
    assert got[1] == ([{"header": "X", "text": "a\n\nb"}], [])
    assert [s["header"] for s in got[2][0]] == ["P Training", "Apdx_A: dditional", "Introduction"] and got[3] == got[4] == ([], [])


def test_equals_the_tree(spark, sf):
    rng = random.Random(11)
    pages = [made(rng) for _ in range(400)] + [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = parsed(spark, pages)
    wrong = [p for i, p in enumerate(pages) if got[i] != (paper_tree.sections(t := paper_tree.tree(p)), paper_tree.tables(t))]
    assert not wrong, (len(wrong), min(wrong, key=len), got[pages.index(min(wrong, key=len))], paper_tree.sections(paper_tree.tree(min(wrong, key=len))))
    assert sum(len(g[0]) for g in got.values()) > 300 and sum(len(g[1]) for g in got.values()) > 30


def test_no_python_worker_and_no_pages(spark, capsys):
    out = papers.parse_papers(spark.createDataFrame([], "id long, html string"), "id", "html")
    assert out.count() == 0
    out.explain()
    plan = capsys.readouterr().out
    assert "InPandas" not in plan and "Python" not in plan and "InArrow" not in plan


def shuffled(spark):
    """Rows that all stages so far have written for shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_pages_are_dealt_once(spark):
    """Pages and their keys move, and one row of a task for a sum; no token, element or text does, joined with whatever."""
    rng = random.Random(11)
    pages = [made(rng) for _ in range(60)]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    kept = {k: spark.conf.get(k, None) for k in (*conf, "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.sources.bucketing.autoBucketedScan.enabled")}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        before = shuffled(spark)
        got = parsed(spark, pages)
        moved = sum(v for k, v in shuffled(spark).items() if k not in before)
    finally:
        for k in conf:
            spark.conf.unset(k) if kept[k] is None else spark.conf.set(k, kept[k])
    assert [got[i] for i in range(60)] == [(paper_tree.sections(t := paper_tree.tree(p)), paper_tree.tables(t)) for p in pages]
    assert 120 <= moved <= 2 * 60 + 2 * spark.sparkContext.defaultParallelism
    assert all(spark.conf.get(k, None) == v for k, v in kept.items()) and not spark.catalog.listTables()


def test_no_table_of_the_steps_is_broadcast(spark, monkeypatch):
    """Small files can hold rows of any size in the driver: only the fixed references are sent to all tasks."""
    plans = []

    def looked_at(df, *where):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return bucketed(df, *where)

    monkeypatch.setattr(papers, "bucketed", looked_at)
    thresholds = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in thresholds]
    out = papers.parse_papers(spark.createDataFrame([(1, PAGE)], "id long, html string"), "id", "html")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    sent = [x for p in plans for x in p.splitlines() if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]
    assert sent and [x for x in sent if "[whole#" not in x and "[short#" not in x] == []
    assert [spark.conf.get(k, None) for k in thresholds] == before and out.count() == 1
