"""Every catalogue query against its DuckDB oracle at sf0.001 (the driver does the same at sf0.01)."""

import pytest

import __spark_entry__ as entry
from cardpulse.plans.catalog import QUERIES
from oracle_check import compare, duck

from conftest import SF001

ORACLE = entry.oracle_sql()
ML = {"best_k", "segments", "local_outliers", "global_outliers", "cluster_profile"}


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF001).toPandas()
    want = con.execute(ORACLE[name]).df()
    assert compare(got, want) == "OK"


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_rows_only_queries_cover_the_rest():
    assert set(QUERIES) - set(ORACLE) == ML
