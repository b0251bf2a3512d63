import pytest

from kelpie.plans import catalog, repos  # noqa: F401
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, name):
    same(spark, sf, catalog.QUERIES, catalog.SQL, name)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert df.columns
    df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
