import pytest
from compare import assert_same

from weftline import queries, workloads  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    assert_same(queries.QUERIES[name](spark, sf_dir), duck.sql(queries.SQL[name]))


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
