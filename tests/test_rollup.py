"""Reports from daily tables of bitmaps equal the row-level ones, on every grain and range."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL, d, ts
from pyspark.sql import functions as F

from ledgerlens import ReportParams, load_inputs
from ledgerlens.operators import unified_transfers
from ledgerlens.plans import ledger, routed
from ledgerlens.plans.rollup import build_rollups, daily_sets, numbers, read_rollups, united_counts, write_rollups

RANGES = [ReportParams("2024-01-01", "2024-01-31"), ReportParams("2024-01-09", "2024-01-10"), ReportParams("2020-01-01", "2020-01-02")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rollups"))
    write_rollups(build_rollups(load_inputs(spark, SF_SMALL)), path)
    return read_rollups(spark, path)


@pytest.mark.parametrize("p", RANGES, ids=str)
def test_ledger_reports_from_sets(spark, stored, p):
    tx = load_inputs(spark, SF_SMALL).ledger_tx
    assert stored.ledger_kpis(p.start, p.end).collect() == ledger.ledger_kpis(tx, p.start, p.end).collect()
    assert set(stored.ledger_status_totals(p.start, p.end).collect()) == set(ledger.ledger_status_totals(tx, p.start, p.end).collect())
    for grain in ("day", "week", "month"):
        for name in ("ledger_status_over_time", "ledger_users_over_time"):
            got = getattr(stored, name)(p.start, p.end, grain)
            assert got.collect() == getattr(ledger, name)(tx, p.start, p.end, grain).collect(), (name, grain)


@pytest.mark.parametrize("rng", [("1995-01-01", "2001-12-31"), ("1998-03-03", "1998-03-20"), ("2020-01-01", "2020-01-02")], ids=str)
def test_routed_reports_from_sets(spark, stored, rng):
    inputs = load_inputs(spark, SF_SMALL)
    rows = unified_transfers(inputs.token_transfers, inputs.contract_calls)
    assert stored.routed_kpis(*rng).collect() == routed.routed_kpis(rows, *rng).collect()
    assert stored.routed_route_totals(*rng).collect() == routed.routed_route_totals(rows, *rng).collect()
    for grain in ("day", "month"):
        assert stored.routed_over_time(*rng, grain).collect() == routed.routed_over_time(rows, *rng, grain).collect()


def test_stored_reports_read_only_the_sets(stored):
    plan = stored.ledger_status_over_time("2024-01-01", "2024-01-31", "month")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PushedFilters: [IsNotNull" in plan and "bitmap_or_agg" in plan


def _tx(spark, rows):
    schema = "tx_id string, tx_from string, tx_succeeded boolean, block_timestamp timestamp_ntz"
    return spark.createDataFrame(rows, schema)


def test_nulls_repeats_and_empty_days(spark):
    rows = [
        ("a", "u", True, ts("2025-01-01 00:00:00")), ("a", "u", True, ts("2025-01-02 00:00:00")),
        ("a", "u", False, ts("2025-01-02 00:00:00")), (None, "u", True, ts("2025-01-03 00:00:00")),
        ("b", None, True, ts("2025-01-03 00:00:00")), (None, None, True, ts("2025-01-20 00:00:00")),
        ("c", "v", None, ts("2025-01-21 00:00:00")), ("d", "v", True, None),
    ]
    tx = _tx(spark, rows)
    none = spark.createDataFrame([], "id string, created_at timestamp_ntz, status string, simplified_status string, sender_address string, recipient_address string, data string")

    class Inputs:
        ledger_tx, token_transfers, contract_calls = tx, none, none.drop("sender_address", "recipient_address")

    made = build_rollups(Inputs)
    for grain in ("day", "week", "month"):
        rng = ("2025-01-01", "2025-01-31")
        assert made.ledger_status_over_time(*rng, grain).collect() == ledger.ledger_status_over_time(tx, *rng, grain).collect()
        assert made.ledger_users_over_time(*rng, grain).collect() == ledger.ledger_users_over_time(tx, *rng, grain).collect()
    assert [tuple(r) for r in made.routed_kpis("2025-01-01", "2025-01-31").collect()] == [(0, 0, None)]
    assert made.routed_over_time("2025-01-01", "2025-01-31").collect() == []


def test_more_values_than_a_bitmap_holds_and_a_hot_one(spark):
    """100,000 ids on ten days, a third of all rows one id on each day."""
    rows = spark.range(100_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("v"),
        F.expr("date_add(DATE'2025-01-01', cast(id % 10 as int))").alias("day"),
    )
    distinct = rows.distinct()
    given = numbers(distinct, "v", "day")
    assert given.count() == given.select("number").distinct().count() == rows.select("v").distinct().count()
    sets = daily_sets(rows, "day", [], "v")
    got = {r["day"]: r["n"] for r in united_counts(sets, ["day"]).collect()}
    assert got == {r["day"]: r["n"] for r in rows.groupBy("day").agg(F.count_distinct("v").alias("n")).collect()}
    assert united_counts(sets, []).first()["n"] == given.count()
    # Numbers by first day: a day's own ids fill few bitmaps beside the hot id's.
    assert sets.count() < 10 * 2 * spark.sparkContext.defaultParallelism
    assert d("2025-01-03") in got


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def _line(plan, text):
    return next(k for k, line in enumerate(plan) if text in line)


def test_bitmaps_are_made_where_their_numbers_are_dealt_to(spark):
    """No shuffle between the partial and the final aggregate (it would move 4 KB a number), none
    that AQE merges before bitmaps are united, and rows are read once."""
    rows = spark.range(1000).selectExpr("string(id % 3) AS m", "string(id) AS v", "date_add(DATE'2025-01-01', int(id % 7)) AS day")
    for apart in (None, "m"):
        sets = daily_sets(rows, "day", ["m"], "v", apart)
        plan = _plan(sets)
        made = plan[_line(plan, "[bitmap_construct_agg(") : _line(plan, "[partial_bitmap_construct_agg(")]
        assert not any("Exchange" in line for line in made)
        assert sum("Range (" in line for line in plan) == 1
        plan = _plan(united_counts(sets, ["day"]))
        united = plan[_line(plan, "[bitmap_or_agg(") : _line(plan, "[bitmap_construct_agg(")]
        assert [line for line in united if "Exchange" in line][0].count("REPARTITION_BY_NUM") == 1


def test_sets_numbered_apart(spark):
    """A value may be in both measures, null, or come again on a day; numbers are each measure's own."""
    rows = [("tx", "a", 1), ("user", "a", 1), ("tx", "b", 1), ("tx", "a", 2), ("tx", "a", 2), ("user", None, 2), (None, "a", 3), ("tx", "c", None)]
    df = spark.createDataFrame(rows, "m string, v string, n int").select("m", "v", F.expr("date_add(DATE'2025-01-01', n)").alias("day"))
    for apart in (None, "m"):
        sets = daily_sets(df, "day", ["m"], "v", apart)
        got = {(r["day"], r["m"]): r["n"] for r in united_counts(sets, ["day", "m"]).collect()}
        assert got == {(r["day"], r["m"]): r["n"] for r in df.groupBy("day", "m").agg(F.count_distinct("v").alias("n")).collect()}
        assert {r["m"]: r["n"] for r in united_counts(sets, ["m"]).collect()} == {"tx": 3, "user": 1, None: 1}


def test_tables_parse_no_json_that_they_do_not_read(spark):
    """Transfers' ids and users are columns; only contract calls are parsed for them."""
    plan = "\n".join(_plan(build_rollups(load_inputs(spark, SF_SMALL)).routed))
    assert plan.count("Generate explode(array(from_json") == 1
