"""Plan-shape guards over every registered batch query (built at sf0.001, not executed).

- no cartesian product anywhere;
- nested-loop joins only where Catalyst folded a single literal row (the UNLISTED category);
- Python operators only in the sequential cart-action fold.
"""

import re

import pytest

from souk.registry import queries

SF = "/root/testdata/sf0.001"
EXECUTES_WHILE_BUILDING = ("stream_", "checkout_")
PYTHON_ALLOWED = {"cart_changes", "cart_change_rejects"}
NESTED_LOOP_ALLOWED = {"cascade_delete_category"}
KEYS = [k for k in queries() if not k.startswith(EXECUTES_WHILE_BUILDING)]


@pytest.mark.parametrize("key", KEYS)
def test_plan_shape(spark, key):
    plan = queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if key not in NESTED_LOOP_ALLOWED:
        assert "BroadcastNestedLoopJoin" not in plan
    python = re.findall(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", plan)
    assert not python or key in PYTHON_ALLOWED, python
