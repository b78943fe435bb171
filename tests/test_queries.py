import pytest

from oracle import connect, same
from quillgraph.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    query, sql = catalog.QUERIES[name]
    if sql:
        same(query(spark, sf), con, sql)
    else:
        assert query(spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
