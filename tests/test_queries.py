"""Every registered query with SQL equals it on DuckDB; the others give rows."""

import pytest

import __spark_entry__ as contract
from oracle_check import connect, differences

SF = "/root/testdata/sf0.01"
SQL = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 4
