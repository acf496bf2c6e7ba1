"""Every registered query against its DuckDB oracle at sf0.001."""

import os

import pytest

import __spark_entry__ as E
from seatflow.plans.registry import all_queries
from tools.oracle_check import compare, duck

SF = os.environ.get("SEATFLOW_TEST_SF", "/root/testdata/sf0.001")
NAMES = sorted(all_queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    missing = set(NAMES) - set(E.oracle_sql())
    assert not missing, missing


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "revenue_cents" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    msg = compare(got, want)
    assert msg is None, msg
