"""Hand-made cases of operators: each gives what its literal table says."""

import cases
import duckdb
import pytest
import registry_cases
from test_entry import rows


@pytest.mark.parametrize("name", [*cases.QUERIES, *registry_cases.QUERIES])
def test_case(spark, name):
    plan = cases if name in cases.QUERIES else registry_cases
    got, want = plan.QUERIES[name](spark, "").toPandas(), duckdb.sql(plan.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
