"""Every core query with SQL gives DuckDB's rows, on the smallest tables."""

import oracle
import pytest

from tilespark.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert not oracle.difference(QUERIES[name](spark, SF), SQL[name], con)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
