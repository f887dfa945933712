"""JSON text is parsed once a branch: filters on leaves don't go below the parse, others do."""

from __future__ import annotations

import re

import pytest
from conftest import SF_SMALL

import __spark_entry__ as se

NAMES = [
    "unified_transfers",
    "routed_kpis",
    "routed_over_time",
    "routed_route_totals",
    "safe_double_extract",
    "contract_call_fee",
    "bridge_over_time",
    "sql_routed_route_totals",
]


#: Branches with a payload: token transfers, contract calls.
BRANCHES = {"unified_transfers": 2, "routed_kpis": 2, "routed_over_time": 2, "routed_route_totals": 2, "sql_routed_route_totals": 2}


@pytest.mark.parametrize("name", NAMES)
def test_one_parse_a_branch(spark, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = se.queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"from_json\(", plan)) == BRANCHES.get(name, 1)


def test_filters_on_other_columns_go_below_the_parse(spark):
    plan = se.queries()["routed_route_totals_1998"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    parses = [k for k, line in enumerate(lines) if "from_json(" in line]
    dates = [k for k, line in enumerate(lines) if "Filter" in line and "1998-01-01" in line]
    assert len(dates) == 2 and all(any(p < d for p in parses) for d in dates)  # children stand below
    assert all("from_json" not in lines[d] for d in dates)
