"""Every registered query against its SQL, on the smallest given data."""

import re

import pytest
from conftest import SMALL

from __spark_entry__ import entry
from check import compare, connect
from reelmill.workload.oracles import oracle_sql
from reelmill.workload.queries import registered

QUERIES, SQL = registered(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = connect(SMALL)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], SQL[name], SMALL) is None


def test_entry(spark):
    assert entry(spark).count() == 9


@pytest.mark.parametrize(
    "name", [n for n in QUERIES if n.startswith(("gold_", "jn_", "agg_", "silver_", "dq_"))]
)
def test_plans_have_no_cross_join_and_no_python(spark, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert not re.search(r"Python|ArrowEval|MapInPandas", plan)


def test_big_joins_have_a_key(spark):
    """Only frames with a fixed number of rows may meet without a key."""
    for name in ("gold_movie_recommendations", "jn_self_theta", "gold_movie_analytics"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan
