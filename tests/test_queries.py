"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as spark_entry
from compare import connect, difference
from snapfold.workloads import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(spark_entry.queries()) and set(SQL) <= set(spark_entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    diff, rows = difference(spark, con, SF, QUERIES[name], SQL[name])
    assert diff is None
    assert rows > 0


def test_plans_stay_in_the_engine_and_join_by_key(spark):
    for name, fn in QUERIES.items():
        if name != "two_runs":  # runs jobs of its own when called
            plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
            for unwanted in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas"):
                assert unwanted not in plan, (name, unwanted)


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
