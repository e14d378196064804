"""Every registered query against its SQL, and what the plans must not hold."""

import pytest

import oracle
from textscreen.plans import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
PYTHON = {"score_in_batches"}
# Windows over a table of one row per bucket, class or part are small by design.


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    frame = QUERIES[name](spark, SMALL)
    assert oracle.difference(frame, connection, SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_one_scan_serves_all_difficulties(spark):
    plan = QUERIES["difficulty_by_name"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4  # two passes over two tables


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "Arrow" not in plan
    for number, line in enumerate(lines := plan.splitlines()):
        if "BroadcastNestedLoopJoin" in line:
            # Only one-row aggregates may be joined without a key.
            assert "BroadcastExchange IdentityBroadcastMode" in plan
        if "Exchange SinglePartition" in line:
            # What goes to one task is already an aggregate or a bounded head.
            below = " ".join(lines[number : number + 5])
            assert "Aggregate" in below, below
