"""Streaming ingest gives the same reports as the batch path, across restarts."""

from __future__ import annotations

from conftest import SF_SMALL
from pyspark.sql import functions as F

from ledgerlens import load_inputs
from ledgerlens.operators import unified_transfers
from ledgerlens.plans import routed
from ledgerlens.streaming import read_unified, start_routed_ingest

S, E = "1995-01-01", "2001-12-31"


def test_ingest_then_report_matches_batch(spark, tmp_path):
    inp = load_inputs(spark, SF_SMALL)
    tt, cc = inp.token_transfers, inp.contract_calls
    src_tt, src_cc = str(tmp_path / "tt"), str(tmp_path / "cc")
    out, ckpt = str(tmp_path / "unified"), str(tmp_path / "ckpt")
    early = F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz")

    # First files arrive, the query catches up and stops.
    tt.where(early).write.mode("append").parquet(src_tt)
    cc.where(early).write.mode("append").parquet(src_cc)
    start_routed_ingest(spark, src_tt, src_cc, out, ckpt, available_now=True).awaitTermination(300)
    first = read_unified(spark, out, S, E).count()

    # More files arrive; a new run resumes from the checkpoint (no row written twice).
    tt.where(~early).write.mode("append").parquet(src_tt)
    cc.where(~early).write.mode("append").parquet(src_cc)
    start_routed_ingest(spark, src_tt, src_cc, out, ckpt, available_now=True).awaitTermination(300)

    batch = unified_transfers(tt, cc)
    assert 0 < first < batch.count()
    table = read_unified(spark, out, S, E)
    assert table.count() == batch.count()
    assert sorted(routed.routed_kpis(table, S, E).collect()) == sorted(routed.routed_kpis(batch, S, E).collect())
    for grain in ("week", "month"):
        assert routed.routed_over_time(table, S, E, grain).collect() == routed.routed_over_time(batch, S, E, grain).collect()
    # A narrow range prunes partitions and still matches.
    assert routed.routed_route_totals(read_unified(spark, out, "1998-03-01", "1998-03-31"), "1998-03-01", "1998-03-31").collect() == (
        routed.routed_route_totals(batch, "1998-03-01", "1998-03-31").collect()
    )


def test_transfer_values_ingest_prices_bridge_events(spark, tmp_path):
    from ledgerlens.operators import (
        BridgeSides,
        bridge_events_in_range,
        bridge_sides,
        price_events,
        priced_bridge_events,
        totals_per_hash,
    )
    from ledgerlens.plans import bridge
    from ledgerlens.streaming import read_transfer_values, start_transfer_values_ingest

    inp = load_inputs(spark, SF_SMALL)
    tt, events = inp.token_transfers, inp.bridge_events
    src, out, ckpt = str(tmp_path / "tt"), str(tmp_path / "values"), str(tmp_path / "ckpt")
    early = F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    for part in (early, ~early):
        tt.where(part).write.mode("append").parquet(src)
        start_transfer_values_ingest(spark, src, out, ckpt, available_now=True).awaitTermination(300)

    for start, end in [(S, E), ("1997-06-01", "1998-06-30")]:
        totals = totals_per_hash(read_transfer_values(spark, out, start, end), start, end)
        from_table = price_events(events, totals, start, end)
        batch = priced_bridge_events(events, tt, start, end)
        assert sorted(from_table.collect()) == sorted(batch.collect())
        sides = BridgeSides(bridge_events_in_range(events, start, end), totals)
        assert bridge.bridge_route_totals(sides).collect() == (
            bridge.bridge_route_totals(bridge_sides(events, tt, start, end)).collect()
        )
