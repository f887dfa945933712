"""Bridge dataset and reports on hand-made rows, checked by hand and against a
brute-force row-level LEFT JOIN (the dashboard's own shape)."""

from __future__ import annotations

import json

from conftest import d, ts
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import hash_part, in_date_range, safe_double
from ledgerlens.operators import BridgeSides, bridge_sides, priced_bridge_events, priced_bridge_rows
from ledgerlens.plans import bridge

EV = "block_timestamp timestamp_ntz, tx_hash string, source_chain string, destination_chain string, sender string, token_symbol string"
TT = "id string, created_at timestamp_ntz, status string, simplified_status string, sender_address string, recipient_address string, data string"
S, E = "2025-01-01", "2025-01-31"


def tdoc(amount, price=None):
    link = {} if price is None else {"price": price}
    return json.dumps({"send": {"amount": amount, "original_source_chain": "Z"}, "link": link})


def inputs(spark):
    events = [
        ("2025-01-02 05:00:00", "0xab", "Ethereum", "osmosis", "s1", "usdc"),
        ("2025-01-02 06:00:00", "0xab", "Ethereum", "osmosis", "s2", "usdc"),
        ("2025-01-03 00:00:00", "0xcd", "ethereum", "kava", "s1", "usdc"),  # no transfer
        ("2025-01-31 23:00:00", "0xef", "Polygon", "kava", "s3", "weth"),  # transfer after the end
        ("2025-01-04 00:00:00", "0xAB", "Ethereum", "osmosis", "s1", "usdc"),  # hash case differs
        ("2025-02-01 00:00:00", "0x11", "Ethereum", "osmosis", "s9", "usdc"),  # after the range
        ("2025-01-05 00:00:00", "0x99", "BSC", "osmosis", "s4", "usdc"),  # unpriced transfer
        ("2025-01-06 00:00:00", "0x77", "ethereum", "osmosis", "s2", "usdc"),
    ]
    ok = ("executed", "received")
    transfers = [
        ("0xab_1", "2025-01-02 07:00:00", *ok, "x", "r", tdoc(1, 10)),
        ("0xab_2", "2025-01-02 07:00:00", *ok, "x", "r", tdoc("2", 5)),
        ("0xab_3", "2025-01-03 07:00:00", *ok, "x", "r", tdoc(1, "10")),
        ("0xab_4", "2025-01-03 07:00:00", "executed", "sent", "x", "r", tdoc(1, 10)),
        ("0xef_1", "2025-02-01 00:00:00", *ok, "x", "r", tdoc(1, 10)),
        ("0x99_1", "2025-01-05 00:00:00", *ok, "x", "r", tdoc(5)),
        ("0x77_1", "2025-01-06 00:00:00", *ok, "x", "r", tdoc(1, 5)),
        ("0x11_1", "2025-02-01 00:00:00", *ok, "x", "r", tdoc(1, 5)),
    ]
    ev = spark.createDataFrame([(ts(r[0]), *r[1:]) for r in events], EV)
    tt = spark.createDataFrame([(r[0], ts(r[1]), *r[2:]) for r in transfers], TT)
    return ev, tt


def test_priced_events(spark):
    ev, tt = inputs(spark)
    rows = {(r.tx_hash, r.sender): r for r in priced_bridge_events(ev, tt, S, E).collect()}
    assert len(rows) == 7  # one row per event in range
    ab = rows[("0xab", "s1")]
    assert (ab.event_date, ab.transfers, ab.priced_transfers, ab.amount, ab.amount_usd) == (d("2025-01-02"), 3, 3, 4.0, 30.0)
    assert (rows[("0xcd", "s1")].transfers, rows[("0xcd", "s1")].amount_usd) == (0, None)
    assert rows[("0xef", "s3")].amount_usd is None  # late transfer does not price it
    assert rows[("0xAB", "s1")].transfers == 0  # no case folding
    assert (rows[("0x99", "s4")].transfers, rows[("0x99", "s4")].priced_transfers) == (1, 0)


def test_bridge_kpis_fan_out(spark):
    ev, tt = inputs(spark)
    k = bridge.bridge_kpis(bridge_sides(ev, tt, S, E)).collect()[0]
    # 0xab: 2 events x (10 + 10 + 10) = 60; 0x77: 5
    assert (k.txn_count, k.user_count, k.volume_usd) == (6, 4, 65.0)


def test_bridge_over_time(spark):
    ev, tt = inputs(spark)
    rows = bridge.bridge_over_time(bridge_sides(ev, tt, S, E), "week").collect()
    assert [(r.bucket, r.txn_count, r.user_count, r.volume_usd) for r in rows] == [
        (d("2024-12-30"), 4, 3, 60.0),
        (d("2025-01-06"), 1, 1, 5.0),
        (d("2025-01-27"), 1, 1, None),
    ]


def test_bridge_route_totals_case_and_order(spark):
    ev, tt = inputs(spark)
    rows = bridge.bridge_route_totals(bridge_sides(ev, tt, S, E)).collect()
    assert [(r.source_chain, r.destination_chain, r.txn_count, r.volume_usd) for r in rows] == [
        ("ethereum", "osmosis", 1, 5.0),
        ("Ethereum", "osmosis", 1, 60.0),
    ]


def test_route_order_transactions_first(spark):
    events = spark.createDataFrame(
        [("a", "b", "h1"), ("c", "d", "h2"), ("c", "d", "h3")],
        "source_chain string, destination_chain string, tx_hash string",
    )
    totals = spark.createDataFrame([("h1", 9.0), ("h2", 2.0), ("h3", 3.0)], "tx_hash string, amount_usd double")
    sides = BridgeSides(events, totals)
    rows = bridge.bridge_route_totals(sides).collect()
    assert [(r.source_chain, r.txn_count, r.volume_usd) for r in rows] == [("c", 2, 5.0), ("a", 1, 9.0)]


def _brute_force_overview(ev, tt, start, end):
    """The dashboard's row-level LEFT JOIN with fan-out (only for tiny fixtures)."""
    tab1 = ev.where(in_date_range("block_timestamp", start, end)).select(
        F.to_date("block_timestamp").alias("date"), "tx_hash", "source_chain", "destination_chain", "sender"
    )
    leaf_amount = F.get_json_object("data", "$.send.amount")
    leaf_price = F.get_json_object("data", "$.link.price")
    tab2 = tt.where(
        (F.col("status") == "executed")
        & (F.col("simplified_status") == "received")
        & in_date_range("created_at", start, end)
    ).select(
        hash_part("id").alias("tx_hash"),
        (safe_double(leaf_amount) * safe_double(leaf_price)).alias("amount_usd"),
    )
    return tab1.join(tab2, "tx_hash", "left")


def test_pre_aggregated_join_equals_row_level_join(spark):
    ev, tt = inputs(spark)
    for start, end in [(S, E), ("2025-01-02", "2025-01-05"), ("2025-01-06", "2025-02-28")]:
        brute = _brute_force_overview(ev, tt, start, end)
        sides = bridge_sides(ev, tt, start, end)
        want = brute.agg(
            F.count_distinct("tx_hash").alias("t"), F.count_distinct("sender").alias("u"), F.round(F.sum("amount_usd")).alias("v")
        ).collect()
        assert bridge.bridge_kpis(sides).collect() == [tuple(want[0])]
        want_routes = sorted(
            tuple(r)
            for r in brute.where(F.col("amount_usd").isNotNull())
            .groupBy("source_chain", "destination_chain")
            .agg(F.count_distinct("tx_hash"), F.round(F.sum("amount_usd")))
            .collect()
        )
        assert sorted(tuple(r) for r in bridge.bridge_route_totals(sides).collect()) == want_routes
        for grain in ("day", "week", "month"):
            want_t = sorted(
                tuple(r)
                for r in brute.groupBy(F.date_trunc(grain, "date").cast("date"))
                .agg(F.count_distinct("tx_hash"), F.count_distinct("sender"), F.round(F.sum("amount_usd")))
                .collect()
            )
            assert sorted(tuple(r) for r in bridge.bridge_over_time(sides, grain).collect()) == want_t


def test_route_report_plans_inner_join(spark):
    ev, tt = inputs(spark)
    plan = bridge.bridge_route_totals(bridge_sides(ev, tt, S, E))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "LeftOuter" not in plan
    plan = bridge.bridge_kpis(bridge_sides(ev, tt, S, E))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan


_HASHES = ["0xa", "0xb", "0xc", "0xA", ""]
_EVENT_HASHES = [*_HASHES, None]
_DAYS = ["2024-12-31", "2025-01-01", "2025-01-15", "2025-01-31", "2025-02-01"]
_event = st.tuples(st.sampled_from(_DAYS), st.sampled_from(_EVENT_HASHES), st.sampled_from(["Ethereum", "ethereum", "BSC"]), st.sampled_from(["s1", "s2", None]))
_transfer = st.tuples(
    st.sampled_from(_HASHES),
    st.integers(0, 9),
    st.sampled_from(_DAYS),
    st.booleans(),
    st.sampled_from([1, 2, "3", [1], None]),
    st.sampled_from([0.5, 1.25, "2", None, True]),
)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_event, min_size=1, max_size=12), st.lists(_transfer, max_size=15))
def test_pre_aggregated_join_equals_row_level_join_random(spark, events, transfers):
    ev = spark.createDataFrame(
        [(ts(day + " 12:00:00"), h, src, "osmosis", snd, "tok") for day, h, src, snd in events], EV
    )
    tt = spark.createDataFrame(
        [
            (f"{h}_{n}", ts(day + " 08:00:00"), "executed", "received" if done else "sent", "x", "r", tdoc(amount, price))
            for h, n, day, done, amount, price in transfers
        ],
        TT,
    )
    brute = _brute_force_overview(ev, tt, S, E)
    sides = bridge_sides(ev, tt, S, E)
    want = brute.agg(F.count_distinct("tx_hash"), F.count_distinct("sender"), F.round(F.sum("amount_usd"))).collect()
    assert [tuple(r) for r in bridge.bridge_kpis(sides).collect()] == [tuple(want[0])]
    want_routes = sorted(
        tuple(r)
        for r in brute.where(F.col("amount_usd").isNotNull())
        .groupBy("source_chain", "destination_chain")
        .agg(F.count_distinct("tx_hash"), F.round(F.sum("amount_usd")))
        .collect()
    )
    assert sorted(tuple(r) for r in bridge.bridge_route_totals(sides).collect()) == want_routes


def test_priced_rows_keep_every_transfer(spark):
    ev, tt = inputs(spark)
    rows = priced_bridge_rows(ev, tt, S, E)
    assert rows.count() == 11  # 2 events x 3 transfers, five events with one row each
    ab = sorted(r.amount_usd for r in rows.where("tx_hash = '0xab'").collect())
    assert ab == [10.0] * 6
    assert [r.amount for r in rows.where("tx_hash = '0xcd'").collect()] == [None]
    assert [(r.amount, r.amount_usd) for r in rows.where("tx_hash = '0x99'").collect()] == [(5.0, None)]


def test_hot_and_null_hashes_are_collapsed_before_the_join(spark):
    n = 1000
    events = spark.range(3 * n).selectExpr(
        "DATE '2025-01-10' AS event_date",
        f"CASE WHEN id < {n} THEN '0xhot' WHEN id < {2 * n} THEN NULL ELSE concat('0x', id) END AS tx_hash",
        "'a' AS source_chain", "'b' AS destination_chain", "concat('s', id % 7) AS sender",
    )
    totals = spark.createDataFrame([("0xhot", 2.0)], "tx_hash string, amount_usd double")
    into_join = bridge._collapsed(events, totals, ["source_chain", "destination_chain"], "left").groupBy("tx_hash").count()
    assert {r["count"] for r in into_join.collect()} == {1}
    k = bridge.bridge_kpis(BridgeSides(events, totals)).collect()[0]
    assert (k.txn_count, k.user_count, k.volume_usd) == (n + 1, 7, 2.0 * n)


def test_volume_branch_has_no_expand(spark):
    ev, tt = inputs(spark)
    for report in (bridge.bridge_kpis, bridge.bridge_over_time, bridge.bridge_route_totals):
        plan = report(bridge_sides(ev, tt, S, E))._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" not in plan
