"""Every registered query against the same result computed by SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from workload.registry import ORACLES, QUERIES
from workload.compare import connect, difference, oracle_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, connection, name):
    frame = contract.queries()[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    ours = spark_rows(frame)
    assert ours[1]
    problem = difference(ours, oracle_rows(connection, contract.oracle_sql()[name]))
    assert problem is None, problem


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= contract.queries().items()


def test_entry(spark):
    assert contract.entry(spark).count() == 500
