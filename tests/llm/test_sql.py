import pytest

from oracle import connect, same
from quillgraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf, name):
    same(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])


def test_fingerprints_of_odd_rows(spark):
    from quillgraph.llm.imatch import fingerprints

    rows = [(1, None, "x"), (2, "", None), (3, "a b c d e f", ""), (3, "a b c d e f", ""), (5, "a b c d e f", ""), (None, "last one", ""), (9, "w " * 30000, "")]
    out = fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 7 and by[3].fingerprint == by[5].fingerprint and by[1].n_chars == 0 and by[1].fingerprint == by[2].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out) and by[5].near_next == 1.0
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_of_rows_without_an_id_and_repeated_ids(spark):
    """Each row is a document: in descending order of ids, then of the md5 of the text, without an id last."""
    import hashlib

    from quillgraph.llm.imatch import fingerprints

    rows = [(None, "a b c d e f g h i j k"), (None, "one two three"), (3, "some words of a text"), (3, "other words, and more of them here"), (3, "some words of a text"), (8, "eight words"), (1, "")]
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], md5(r[1])), reverse=True)
    want = []
    for (d, t), (_, n) in zip(order, [*order[1:], order[0]]):
        k = len(t) // 3
        want.append((d, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest(), float(t == n)))
    out = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out), key=key) == sorted((w[:3] for w in want), key=key)
    assert sum(r.near_next == 1.0 for r in out) == sum(w[3] for w in want) == 1


def test_fingerprint_likeness(spark):
    """Near one for a word's change, whatever the length; texts without lexicon terms too."""
    from quillgraph.llm import imatch

    base = [f"w{i}" for i in range(400)]
    for n in (12, 60, 400):
        t = sorted(int(__import__("hashlib").md5(x.encode()).hexdigest()[:15], 16) for x in base[:n])
        for m, low, high in ((n, 1, 1), (n - 1, 0.7, 1), (n // 2, 0.1, 0.75), (n // 5, 0, 0.45)):
            df = spark.createDataFrame([(t, sorted(t[:m]))], "a array<long>, b array<long>")
            df = df.select(imatch.prints("a", "''").alias("a"), imatch.prints("b", "''").alias("b"))
            assert low <= df.select(imatch.likeness("a", "b")).first()[0] <= high
