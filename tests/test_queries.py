"""Every registered query with an SQL twin gives the same rows on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from workbench.check import connection, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) > 0
    if name in SQL:
        assert differences(got, con.execute(SQL[name]).df()) is None


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["journal", "rank", "id", "issn", "d2"]
    assert result.count() == 20 * 10
