"""SQL-text reports (bound parameters) give the same rows as the DataFrame reports."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL

from ledgerlens import Dashboard, ReportParams, load_inputs
from ledgerlens.plans.sql import GRAINED, REPORT_SQL, register_views, run_sql

RANGES = {"ledger": ("2024-01-01", "2024-01-20"), "routed": ("1996-03-01", "1999-12-31"), "bridge": ("1996-03-01", "1999-12-31")}


@pytest.fixture(scope="module")
def inputs(spark):
    inp = load_inputs(spark, SF_SMALL)
    register_views(inp)
    return inp


@pytest.mark.parametrize("name", sorted(REPORT_SQL))
def test_sql_matches_dataframe(spark, inputs, name):
    start, end = RANGES[name.split("_")[0]]
    for grain in ("day", "week", "month") if name in GRAINED else ("week",):
        want = Dashboard(inputs, ReportParams(start, end, grain)).report(name).collect()
        assert run_sql(spark, name, start, end, grain).collect() == want, (name, grain)  # views
        assert run_sql(spark, name, start, end, grain, inputs=inputs).collect() == want, (name, grain)


def test_sql_rejects_unknown_grain(spark, inputs):
    with pytest.raises(ValueError):
        run_sql(spark, "routed_over_time", "1996-01-01", "1996-12-31", "hour")
