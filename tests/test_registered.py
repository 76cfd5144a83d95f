"""Every registered query against its SQL; the others must give rows."""

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, connect

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], SQL[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["year", "month", "target", "count", "percentage"] and df.count() > 0
