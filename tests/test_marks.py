"""The runtime filter by the events' hashes: nothing is lost, little passes."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from ledgerlens import load_inputs
from ledgerlens.operators import bridge_sides, hash_marks, marked, priced_bridge_events, priced_bridge_rows
from ledgerlens.operators.bridge import bridge_events_in_range, transfer_values
from ledgerlens.plans import bridge

RANGES = [("1998-03-01", "1998-03-02"), ("1995-01-01", "2001-12-31"), ("2030-01-01", "2030-01-02")]


@pytest.mark.parametrize("rng", RANGES, ids=str)
def test_pruned_results_are_the_same(spark, rng):
    inp = load_inputs(spark, SF_SMALL)
    for made in (priced_bridge_events, priced_bridge_rows):
        plain, pruned = (made(inp.bridge_events, inp.token_transfers, *rng, prune=p).collect() for p in (False, True))
        assert sorted(map(str, plain)) == sorted(map(str, pruned))
    for report in (bridge.bridge_kpis, bridge.bridge_over_time, bridge.bridge_route_totals):
        plain, pruned = (report(bridge_sides(inp.bridge_events, inp.token_transfers, *rng, prune=p)).collect() for p in (False, True))
        assert plain == pruned


def test_transfers_fall_with_the_range(spark):
    inp = load_inputs(spark, SF_SMALL)
    rows = {}
    for rng in RANGES:
        marks = hash_marks(bridge_events_in_range(inp.bridge_events, *rng))
        rows[rng] = transfer_values(inp.token_transfers, marks).count()
    every = transfer_values(inp.token_transfers).count()
    assert rows[RANGES[2]] == 0 and rows[RANGES[0]] < 0.02 * every and rows[RANGES[1]] > 0.5 * every


def test_marks_hold_all_hashes_and_few_others(spark):
    some = spark.range(20_000).select(F.concat(F.lit("0x"), "id").alias("tx_hash"))
    other = spark.range(20_000, 220_000).select(F.concat(F.lit("0x"), "id").alias("tx_hash"))
    marks = hash_marks(some.unionByName(spark.createDataFrame([(None,)], "tx_hash string")))
    assert marked(some, marks, F.col("tx_hash")).count() == 20_000
    assert marked(other, marks, F.col("tx_hash")).count() < 0.005 * 200_000
    assert hash_marks(other).count() <= 1 << 18


def test_unmarked_payloads_are_not_read(spark):
    inp = load_inputs(spark, SF_SMALL)
    plan = priced_bridge_rows(inp.bridge_events, inp.token_transfers, *RANGES[0], prune=True)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    parse = next(k for k, line in enumerate(lines) if "from_json(" in line)
    assert any("__bits" in line for line in lines[parse + 1 :])  # the filter stands below the parse


@pytest.mark.parametrize("report", ["routed_kpis", "routed_over_time"])
def test_routed_reports_have_no_expand(spark, report):
    import __spark_entry__ as se

    for name in (report, "sql_" + report):
        plan = se.queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" not in plan
