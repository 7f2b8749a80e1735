"""Every registered plan equals its DuckDB oracle on the driver tables."""

import pytest

import __spark_entry__ as E
from conftest import SF_CHECK
from oracle_check import compare, duck, type_mismatches

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_CHECK)
    ok, msg = compare(sdf.toPandas(), con.execute(SQL[name]).df())
    assert ok, msg
    assert not type_mismatches(sdf.dtypes, con.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_CHECK).count() >= 1


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "customer_id" in df.columns
