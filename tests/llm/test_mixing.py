import duckdb
import pandas as pd

from quillgraph.llm import mixing

COLS = "doc_id long, text string, source string, size string, n_chars long"


def run(spark, rows):
    return mixing.mix(spark.createDataFrame(rows, COLS)).select("doc_id", "size", "source_size", "target", "taken").toPandas()


def test_equals_sql_and_budgets(spark):
    rows = [(i, "w " * (i % 7), ["a", "b", None, "c", "A"][i % 5 if i % 3 else 0], "clash", 1) for i in range(300)] + [(1, "x y", "a", "", 2)] * 3 + [(500, None, "null text", None, None)]
    got = run(spark, rows)
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source", "size", "n_chars"])  # noqa: F841
    want = duckdb.sql(mixing.SQL).df()
    key = ["doc_id", "size", "taken"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)
    assert (got.taken <= 3 * got["size"]).all()
    per = got.groupby("source_size").agg(t=("target", "first"), k=("taken", "sum"))
    assert ((per.t - per.k) < 1.01).all() and abs(per.t.sum() - got["size"].sum()) < 1e-6


def test_empty_and_copies(spark):
    assert run(spark, []).empty
    rows = [(i, "one two  three", "s" if i else "t", "", 14) for i in range(6)]
    out = mixing.mixed(spark.createDataFrame(rows, COLS))
    assert out.columns == [c.split()[0] for c in COLS.split(", ")]
    words = sum(len(r.text.split()) for r in out.collect())
    assert words == run(spark, rows).taken.sum()


def test_columns_with_the_names_of_helpers(spark):
    names = ["before_range", "_before_range", "_s", "_r", "_key", "_range", "_g", "_digits", "weight", "_weight", "_n", "n", "_own_size", "size", "SIZE_", "taken", "in_range"]
    rows = [(i, "one two  three", "s" if i % 3 else None, *(f"{c}{i}" for c in names)) for i in range(9)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{c}` string" for c in names)]))
    out = mixing.mix(docs)
    assert set(out.columns) == {*docs.columns, "source_size", "target"} and all(r["_range"] == f"_range{r.doc_id}" and r["_key"] == f"_key{r.doc_id}" for r in out.collect())
    again = mixing.mixed(docs)
    assert again.columns == docs.columns and all(r[c] == f"{c}{r.doc_id}" for r in again.collect() for c in names)
