"""Input readers: catalog tables, validation, flag normalisation."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL

from ledgerlens import Dashboard, ReportParams, from_frames, from_tables, load_inputs


def test_from_tables_reads_catalog_views(spark):
    derived = load_inputs(spark, SF_SMALL)
    for name in ("ledger_tx", "token_transfers", "contract_calls", "bridge_events"):
        getattr(derived, name).createOrReplaceTempView(f"t_{name}")
    inputs = from_tables(spark, "t_ledger_tx", "t_token_transfers", "t_contract_calls", "t_bridge_events")
    p = ReportParams("1995-01-01", "2024-12-31", "month")
    for report in ("ledger_kpis", "routed_kpis", "bridge_kpis"):
        assert Dashboard(inputs, p).report(report).collect() == Dashboard(derived, p).report(report).collect()


def test_missing_columns_are_reported(spark):
    derived = load_inputs(spark, SF_SMALL)
    with pytest.raises(ValueError, match="token_transfers is missing columns"):
        from_frames(derived.ledger_tx, derived.token_transfers.drop("sender_address"), derived.contract_calls, derived.bridge_events)


def test_text_flag_column_is_normalised(spark):
    derived = load_inputs(spark, SF_SMALL)
    text_flag = derived.ledger_tx.selectExpr(
        "tx_id", "tx_from", "CASE WHEN tx_succeeded THEN 'TRUE' WHEN NOT tx_succeeded THEN 'FALSE' END AS tx_succeeded", "block_timestamp"
    )
    inputs = from_frames(text_flag, derived.token_transfers, derived.contract_calls, derived.bridge_events)
    assert dict(inputs.ledger_tx.dtypes)["tx_succeeded"] == "boolean"
    p = ReportParams("2024-01-01", "2024-01-31", "week")
    for report in ("ledger_kpis", "ledger_status_totals"):
        assert Dashboard(inputs, p).report(report).collect() == Dashboard(derived, p).report(report).collect()


def test_date_columns_prune_partitions(spark, tmp_path):
    from ledgerlens import from_parquet

    derived = load_inputs(spark, SF_SMALL)
    stamps = {"ledger_tx": "block_timestamp", "token_transfers": "created_at", "contract_calls": "created_at", "bridge_events": "block_timestamp"}
    days = {"ledger_tx": "block_date", "bridge_events": "block_date", "token_transfers": "created_date"}
    for name, stamp in stamps.items():
        df = getattr(derived, name)
        if name in days:
            # by month's first day would do for the size; a day column is what the reports expect
            df = df.selectExpr("*", f"CAST({stamp} AS DATE) AS {days[name]}").where(f"year({stamp}) IN (1998, 2024)")
            df = df.where(f"day({stamp}) < 5 AND month({stamp}) = 1").write.partitionBy(days[name])
        else:
            df = df.write
        df.parquet(str(tmp_path / name))
    plain, dated = from_parquet(spark, str(tmp_path)), from_parquet(spark, str(tmp_path), days)
    for report, p in [
        ("ledger_kpis", ReportParams("2024-01-02", "2024-01-03", "week")),
        ("bridge_over_time", ReportParams("1998-01-01", "1998-01-03", "day")),
        ("routed_kpis", ReportParams("1998-01-01", "1998-01-03", "week")),
    ]:
        got = Dashboard(dated, p).report(report)
        assert got.collect() == Dashboard(plain, p).report(report).collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert any(f"PartitionFilters: [isnotnull({c}" in plan for c in set(days.values()))


def test_unknown_date_column_input(spark):
    derived = load_inputs(spark, SF_SMALL)
    with pytest.raises(ValueError, match="no such inputs"):
        from_frames(derived.ledger_tx, derived.token_transfers, derived.contract_calls, derived.bridge_events, {"orders": "d"})
