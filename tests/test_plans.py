"""Plan guards: no nested-loop / cartesian joins in queries that once risked them."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

GUARDED = ["eligibility_summary", "port_snapshot", "occupancy_series", "wi_delay", "wi_conflict",
           "fifo_replay", "conflict_pairs", "window_availability", "queue_board"]


@pytest.mark.parametrize("name", GUARDED)
def test_no_nested_loop_join(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
