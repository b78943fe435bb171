from collections import Counter

import numpy as np

import corpus_pipeline as P
from quillgraph.llm import minhash, substring, toxicity

AT = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    kinds = docs.dtypes
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, AT).toPandas()
        if name != "pack":
            assert list(out.columns) == [c for c, _ in kinds]
        seen[name] = (docs.toPandas(), out)
        docs = spark.createDataFrame(out)

    before, after = seen["toxicity"]
    bad = {r.doc_id for r in toxicity.toxicity(spark.createDataFrame(before), spark.read.parquet(f"{AT}/labels.parquet")).collect() if r.predicted}
    assert set(before.doc_id) - set(after.doc_id) == bad
    before, after = seen["near_duplicates"]
    keep = {r.doc_id for r in minhash.near_duplicates(spark.createDataFrame(before)).collect() if r.kept}
    assert set(after.doc_id) == keep and len(after) == len(keep) < len(before)
    before, after = seen["substring_dedup"]
    want = {r.doc_id: (r.n_removed, r.kept) for r in substring.removed(spark.createDataFrame(before)).collect()}
    old = dict(zip(before.doc_id, before.text))
    assert sorted(after.doc_id) == sorted(before.doc_id)
    assert all(r.text == (want[r.doc_id][1] if want[r.doc_id][0] else old[r.doc_id]) for r in after.itertuples())
    before, after = seen["mix_sources"]
    n, m = (Counter() for _ in range(2))
    for c, d in ((n, before), (m, after)):
        for r in d.itertuples():
            c[r.source] += len(r.text.encode().split())
    assert all(m[s] <= 3 * n[s] for s in n) and abs(sum(m.values()) - sum(n.values())) <= len(n)
    before, after = seen["pack"]
    assert after.length.sum() == after.drop_duplicates(["sequence_id", "offset"]).length.sum() and (after.groupby("sequence_id").length.sum() <= 1024).all()
    assert set(after.doc_id) == set(before.doc_id) and (np.array([len(x) for x in after.ids]) == after.length).all()


def test_odd_rows(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, size string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, None), (None, "no id", "en", "a", 5, None), (3, "one two", "en", "b", 7, "y"), (3, "one two", "en", "b", 7, "y"), (4, "w " * 5000, "en", "b", 10000, "")]
    docs = spark.createDataFrame(rows, kinds)
    for some in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, some, AT)
            got = out.collect()
            assert name == "pack" or out.columns == some.columns
            some = spark.createDataFrame(got, out.schema)
