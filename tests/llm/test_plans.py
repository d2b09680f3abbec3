import pytest

from tillbook.llm.queries import QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_joins(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
