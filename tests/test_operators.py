import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import audit, bundle, ensemble, graph, joins, sampling
from quillgraph.plans import runner
from quillgraph.sources import files, http, search
from quillgraph.streaming import live


def test_edge_score(spark):
    c = F.array(*(F.lit("x" * n) for n in (100, 130, 10)))
    assert spark.range(1).select(graph.edge_score(F.lit(True), c, F.array(F.lit("methodology"))).alias("s")).first().s == 20.5


def test_greedy_expansion(spark):
    e = spark.createDataFrame([("S", "P1", 1, 9.0, 1.0), ("S", "P2", 2, 8.0, 1.0), *[(p, x, i, 9.0 - i, 1.0) for p in ("P1", "P2") for i, x in enumerate("abc")], ("T", "x", 1, 1.0, 900.0), ("T", "y", 2, 2.0, 100.0)], "src string, dst string, pos int, score double, cited double")
    out = graph.expand_greedily(e, spark.createDataFrame([("S",), ("T",)], "seed string"), (2, 1)).collect()
    assert sorted((r.parent, r.node) for r in out if r.seed == "S" and r.depth == 2) == [("P1", "a"), ("P2", "b")]
    assert [(r.node, r.score) for r in sorted((r for r in out if r.seed == "T"), key=lambda r: r["rank"])] == [("x", 9.0), ("y", 1.0)]


def test_prefix_and_title(spark):
    dim = spark.createDataFrame([(0, "gpt-4.1-mini"), (1, "gpt-4.1"), (2, "gpt")], "ord int, prefix string")
    rows = spark.createDataFrame([("gpt-4.1-mini-x",), ("gpt-4.1-y",), ("z",), (None,)], "m string")
    assert {r.m: r.ord for r in joins.prefix_join(rows, "m", dim).collect()} == {"gpt-4.1-mini-x": 0, "gpt-4.1-y": 1, "z": None, None: None}
    assert {r.m: r.ord for r in joins.prefix_join(rows, "m", dim, longest=False).collect()}["gpt-4.1-y"] == 1
    t = spark.createDataFrame([(1, 1, "A long title about graphs"), (2, 2, "abc"), (3, 3, "Xabcx")], "tid long, pos long, title string")
    q = spark.createDataFrame([(1, "long title about"), (2, " ABC "), (3, "bcx"), (4, "none of them")], "qid long, title string")
    assert {r.qid: r.tid for r in joins.first_title(q, t).collect()} == {1: 1, 2: 2, 3: 3, 4: None}


def test_tiers(spark):
    d = spark.createDataFrame([(0, 3, True), (1, 3, True), (0, 2, True), (3, 3, False)], "a int, c int, ok boolean")
    assert [r[0] for r in d.select(ensemble.tier(F.col("a"), F.col("c"), F.col("ok"))).collect()] == ["gold", "silver", "bronze", "rejected"]


def test_case_ids(spark):
    good = audit.case_parts(spark.createDataFrame([("vf_q_1_c12",)], "case_id string")).first()
    assert (good.kind, good["sample"], good.idx) == ("vf", "q_1", 12)
    with pytest.raises(Exception, match="bad case id"):
        audit.case_parts(spark.createDataFrame([("zz",)], "case_id string")).collect()


def test_quota_and_turns(spark):
    d = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 100)], "v string, s int")
    assert sorted(r.s for r in sampling.stratified_quota(d, "v", [F.col("s").desc()], 5, 2).collect()) == [6, 7, 8, 9, 100]
    assert [r.s for r in sampling.round_robin(d, "v", [F.col("s").desc()], 3).collect()] == [100, 9, 8]


def test_bundle_and_claims(spark):
    hops = spark.createDataFrame([("s", "a", "b"), ("s", "a", "c")], "seed string, mid string, node string")
    info = spark.createDataFrame([("a", "A", "1.1", 2020, None)], "id string, title string, arxivId string, year int, abstract string")
    g = bundle.package(hops, info)
    row = g.first()
    assert row.edges == {"s": ["a"], "a": ["b", "c"]} and row.nodes["a"].title == "A" and row.nodes["b"].title == ""
    pool = spark.createDataFrame([("1.1", [("H", "t")])], "arxiv_id string, sections array<struct<header:string,text:string>>")
    out = bundle.load(spark.createDataFrame([("s",), ("none",)], "id string"), g, pool).orderBy("id").collect()
    assert out[0].content is None and out[1].content["1.1"][0].header == "H"
    claims = spark.createDataFrame([("s", 1, "accuracy of 93.5% with attention", "Results"), ("s", 2, "nothing alike", "Results"), ("s", 3, "x", ""), ("s", 4, "some words here", "Zebra")], "sample string, claim_id int, claim string, source_section string")
    secs = spark.createDataFrame([("s", 0, "Intro", "text"), ("s", 1, "4 Results", "we get 93.5% accuracy with attention")], "sample string, pos int, header string, text string")
    assert {r.claim_id: r.band for r in bundle.verify_claims(claims, secs).collect()} == {1: "confirmed", 2: "no_match", 3: "skip_empty", 4: "section_not_found"}


def test_files(spark, tmp_path):
    a = tmp_path / "a"
    a.mkdir()
    (a / "x.jsonl").write_text('{"id": "1", "v": 1}\n{"id": "2", "v": 2}\n{"id": "1", "v": 3}\n')
    assert {r.id: r.v for r in files.json_lines(spark, str(a), "id string, v int", key="id").collect()} == {"1": 3, "2": 2}
    assert files.json_lines(spark, str(tmp_path / "none"), "id string", missing_ok=True).count() == 0
    names = spark.createDataFrame([("a", str(a / "x.jsonl")), ("b", str(tmp_path / "none"))], "name string, path string")
    prints = {r.name: r.print for r in files.fingerprints(spark, names).collect()}
    assert prints == {"a": hashlib.sha256((a / "x.jsonl").read_bytes()).hexdigest()[:16], "b": ""}
    (a / "bad.jsonl").write_text('{"id": "9", "v": 1}\n{broken\n')
    assert files.json_lines(spark, str(a / "bad.jsonl"), "id string, v int", tolerant=True).collect()[0].id == "9"
    d = tmp_path / "docs"
    d.mkdir()
    for n in ("summary_1", "b", "c", "d"):
        (d / f"{n}.json").write_text(json.dumps({"id": n}))
    assert sorted(r.id for r in files.json_documents(spark, str(d), "id string", skip_prefix="summary", start=1, stop=2).collect()) == ["c", "d"]
    assert {r.file: r.value for r in files.header_peek(spark, str(d), r'"id": "(\w)"').collect()}["b.json"] == "b"
    df = spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, v int")
    files.write_per_key(df, str(tmp_path / "per"), "k")
    assert spark.read.json(str(tmp_path / "per")).count() == 2
    files.write_lines(df, str(tmp_path / "t" / "v1"))
    files.rewrite(spark, str(tmp_path / "t"), "k string, v int", lambda x: x.where("v > 1"))
    assert spark.read.json(str(tmp_path / "t" / "v2")).count() == 1 and spark.read.json(str(tmp_path / "t" / "v1")).count() == 2
    old = spark.createDataFrame([("q_0000",)], "id string")
    assert [r.id for r in files.append_with_ids(old, df, "id", "q_", [F.col("k")]).orderBy("id").collect()] == ["q_0000", "q_0001", "q_0002"]
    files.request_lines(spark.createDataFrame([("a", "hi"), ("b", "x" * 50)], "custom_id string, prompt string"), str(tmp_path / "req"), "m", limit=10)
    assert json.loads(spark.read.text(str(tmp_path / "req")).first()[0])["body"]["messages"][0]["content"] == "hi"


def test_http(spark):
    answers = {"u": [(429, ""), (200, json.dumps({"data": [{"id": 1}], "token": "t"}))], "u&token=t": [(200, json.dumps({"data": [{"id": 2}]}))], "w": [(404, "")]}
    waits: list[float] = []
    assert [r["id"] for r in http.pages("u", lambda url: answers[url].pop(0), sleep=waits.append)] == [1, 2] and 30.0 in waits
    assert http.fetch("w", lambda url: answers[url].pop(0), sleep=waits.append) == {} and http.cache_key("http://a/b?c") != http.cache_key("http://a/b?d")

    def transport(url):
        return 200, json.dumps({"data": [{"id": int(url)}]})

    http.register(spark, "papers_test", "id long", transport, spacing=0.0)
    assert sorted(r.id for r in spark.read.format("papers_test").option("urls", '["1", "2"]').load().collect()) == [1, 2]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    t = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "k string, is_correct boolean")
    t.write.json(str(tmp_path / "in" / "b"))
    s = spark.readStream.schema("k string, is_correct boolean").json(str(tmp_path / "in" / "b"))
    q = live.running_accuracy(s, "k").writeStream.format("memory").queryName("acc").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {tuple(r) for r in spark.table("acc").collect()} == {tuple(r) for r in live.running_accuracy(t, "k").collect()}


def test_runner(spark, tmp_path):
    stages = [("one", lambda s, t: s.range(3)), ("two", lambda s, t: t["one"].where("id > 0"))]
    assert runner.run(spark, stages, str(tmp_path)) == ["one", "two"]
    assert runner.run(spark, stages, str(tmp_path), first="two") == ["two"] and spark.read.parquet(f"{tmp_path}/two").count() == 2


def test_schemas_and_reads(spark):
    from quillgraph import schemas
    from quillgraph.operators import report

    for name in ("PAPER", "QA", "GRAPHS", "POOL", "REFERENCES", "VOTES", "TRIAGE_VERDICTS", "TRAJECTORIES"):
        assert spark.createDataFrame([], getattr(schemas, name)).count() == 0
    row = ("s", [([("read_section", {"paper_id": "p", "section": "B"}, "=== 2 Method ===\ntext"), ("read_section", {"paper_id": "p", "section": "X"}, "REJECTED: x"), ("read_section", {"paper_id": "p", "section": "Y"}, "text"), ("think", {}, "")],)])
    t = spark.createDataFrame([row], "sample_id string, turns array<struct<tool_results:array<struct<name:string,args:map<string,string>,output:string>>>>")
    n = spark.createDataFrame([("s", "p", "1.1")], "sample string, pid string, arxiv_id string")
    assert sorted((r.paper, r.section) for r in report.section_reads(t, n).collect()) == [("1.1", "2 Method"), ("1.1", "Y")]


def test_files_by_name(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"s{i}.json").write_text(json.dumps({"id": i}))
    (tmp_path / "meta0.json").write_text("no json at all")
    at = lambda **o: sorted(r.id for r in files.json_documents(spark, str(tmp_path), "id long", "meta", **o).collect())
    assert at() == [0, 1, 2, 3] and at(start=1, stop=2) == [1, 2] and at(start=9) == []
    (tmp_path / "one.json").write_text(json.dumps([{"id": 7}, {"id": 8}]))
    assert files.release(spark, str(tmp_path / "one.json"), "id long").count() == 2
    (tmp_path / "rel" / "qa").mkdir(parents=True)
    (tmp_path / "rel" / "qa" / "full.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    assert files.release(spark, str(tmp_path / "rel"), "id long").count() == 2


def test_chain_and_verdict_files(spark, tmp_path):
    (tmp_path / "chains_d1.json").write_text(json.dumps([{"depth": 1, "path": ["a"]}]))
    (tmp_path / "chains_d2.json").write_text(json.dumps([{"depth": 2, "path": ["a", "b"]}, {"depth": 2, "path": ["a"]}]))
    kinds = "depth int, path array<string>"
    assert [files.chain_files(spark, str(tmp_path), kinds, **o).count() for o in ({}, {"depth": 2}, {"depth": 2, "steps": 2})] == [3, 2, 1]
    for who in ("ann", "bo"):
        (tmp_path / "verdicts" / who).mkdir(parents=True)
        (tmp_path / "verdicts" / who / "c1.json").write_text(json.dumps({"case_id": "vf_1_c0"}))
    assert sorted(r.auditor for r in files.verdict_dirs(spark, str(tmp_path / "verdicts"), "case_id string").collect()) == ["ann", "bo"]


def test_combined_failed_and_report_files(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "error")], "id int, terminated_by string"), spark.createDataFrame([(2, "x")], "id int, more string")
    files.write_combined([a, b], str(tmp_path / "all"))
    files.write_failed(a.unionByName(b, allowMissingColumns=True), str(tmp_path / "failed"))
    assert spark.read.json(str(tmp_path / "all")).count() == 2 and spark.read.json(str(tmp_path / "failed")).first().id == 1
    from quillgraph.operators import evaluation
    from quillgraph.plans import tables

    files.write_report(evaluation.evaluation(tables.runs(spark, "/root/testdata/sf0.001"), {"model": "m"}), str(tmp_path / "report"))
    got = json.loads(spark.read.text(str(tmp_path / "report")).first()[0])
    assert got["fingerprint"] == {"model": "m"} and got["total"] == 1500 and set(got["sections"]["predicted"]) == set("ABCD")
    assert evaluation.evaluation(tables.runs(spark, "/root/testdata/sf0.001").limit(0)).first().total == 0


def test_response_cache(tmp_path):
    asked = []
    send = lambda u: (asked.append(u), (200, '{"data": [1]}'))[1]
    for _ in range(2):
        assert http.fetch("http://x/a?b", send, sleep=lambda s: None, cache=search.SharedCache(f"file://{tmp_path}")) == {"data": [1]}
    assert len(asked) == 1 and len(search.SharedCache(f"file://{tmp_path}")) == 1


def test_contents_memoised(spark):
    from quillgraph.operators import seeds

    pool = spark.createDataFrame([("a", "A")], "id string, content string")
    pages = spark.createDataFrame([("a", "<a>"), ("b", "<b>"), ("b", "<b>")], "id string, html string")
    want = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "id string")
    out = seeds.contents(want, pool, pages, lambda h: F.upper(h)).collect()
    assert sorted(map(tuple, out)) == [("a", "A", False), ("b", "<B>", True)]
