"""Every registered query against its SQL check, over whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from lakeseed.plans.queries import all_checks, all_queries
from tests.compare import check_connection, compare

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return check_connection(FOLDER)


def test_every_query_has_a_check():
    assert set(all_queries()) == set(all_checks())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_check(spark, connection, name):
    frame = all_queries()[name](spark, FOLDER)
    assert compare(frame, connection, all_checks()[name]) == []
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython") if node in plan]
    assert "SinglePartition" not in plan or "partial_count" in plan


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns[:3] == ["query_id", "rank", "doc_id"]
    small = check_connection("/root/testdata/sf0.001")
    assert compare(frame, small, contract.oracle_sql()[contract.FLAGSHIP]) == []
    assert set(all_queries()) <= set(contract.queries())
