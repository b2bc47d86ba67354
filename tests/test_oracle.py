import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    problem, _, _, _ = compare(spark, con, name, QUERIES[name], SQL[name], SMALL)
    assert not problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns and df.collect() is not None


def test_entry(spark):
    assert {r["lang"] for r in entry.entry(spark).collect()} == {"en", "de", "fr", "es"}
