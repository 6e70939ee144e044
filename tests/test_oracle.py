"""Every registered query against its DuckDB oracle on the smallest test scale."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle.compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF)
    sql = oracle_sql().get(name)
    if sql is None:
        df.count()
        return
    res = compare(df, con, sql)
    assert res["match"], res


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "uninvoiced_quantity" in df.columns
