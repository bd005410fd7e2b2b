"""The queries over elements make them once, however many steps read them."""

import pytest

from inkspan.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["elements_below", "element_paths"])
def test_elements_are_made_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(raw" not in plan and "Window" not in plan
