"""Every registered query against its SQL oracle (DuckDB), as the driver does."""

import pytest

import __spark_entry__ as entry
from oracle_compare import compare, duck_connection

from conftest import SF_SMALL
from vitalspark.plans import registry

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


def test_every_query_has_an_oracle():
    # training-data queries that SQL cannot express are tested in tests/llm
    assert set(registry.queries()) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    res = compare(spark, SF_SMALL, key, QUERIES[key], SQL[key], con)
    assert res["status"] == "match", res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["Id", "AvgSteps", "AvgMinutesAsleep", "UserSegment"]
    assert df.count() > 0
