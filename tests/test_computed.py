"""Plans of large score expressions."""

import pytest

from sluicework.plans import catalogue, rules


@pytest.mark.parametrize("query", [catalogue.quality_scores, rules.persist_gate])
def test_generators_only_pass_values_on(spark, query):
    """Rules stand in a projection of their own, as a generator interprets what it holds, row by row."""
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    held = [line for line in plan.split("\n") if "Generate " in line]
    assert held and not any("RLIKE" in line or "CASE WHEN" in line or "regexp_replace" in line for line in held)
