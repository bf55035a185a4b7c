import pytest

from docflow import catalog
from tests.oracle import SF, agree

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        agree(df, ORACLE[name])
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
