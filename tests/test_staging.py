"""Stored inputs (JSON text or VARIANT payload) give the same reports as derived ones."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL

from ledgerlens import REPORT_NAMES, Dashboard, ReportParams, from_frames, load_inputs
from ledgerlens.plans.sql import REPORT_SQL, register_views, run_sql
from ledgerlens.sources import stage_inputs, store_inputs, stored_inputs

PARAMS = {"ledger": ReportParams("2024-01-01", "2024-01-31", "week"), "other": ReportParams("1996-01-01", "2000-06-30", "month")}


@pytest.mark.parametrize("data_type", ["variant", "string"])
def test_staged_reports_match(spark, tmp_path, data_type, capsys):
    staged = stage_inputs(spark, SF_SMALL, str(tmp_path / data_type), data_type)
    assert staged.token_transfers.schema["data"].dataType.typeName() == data_type
    derived = load_inputs(spark, SF_SMALL)
    for name in REPORT_NAMES:
        p = PARAMS["ledger" if name.startswith("ledger") else "other"]
        assert Dashboard(staged, p).report(name).collect() == Dashboard(derived, p).report(name).collect(), name
    if data_type == "variant":
        # Only the leaves a report uses are read from the shredded payload.
        Dashboard(staged, PARAMS["other"]).report("routed_kpis").explain("formatted")
        plan = capsys.readouterr().out
        assert "data:struct<0:string,1:string>" in plan


def test_stage_rejects_unknown_type(spark, tmp_path):
    with pytest.raises(ValueError):
        stage_inputs(spark, SF_SMALL, str(tmp_path / "x"), "binary")


def _row_groups(path):
    import glob

    import pyarrow.parquet as pq

    return sum(pq.ParquetFile(f).num_row_groups for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


def test_staged_tables_feed_all_cores_and_lie_by_day(spark, tmp_path):
    """One row group a table comes in; one a core at least goes out, in order of days."""
    import glob

    import pyarrow.parquet as pq

    from ledgerlens.sources.layout import TIMES

    stage_inputs(spark, SF_SMALL, str(tmp_path / "in"), "string")
    cores = spark.sparkContext.defaultParallelism
    for name, timestamp in TIMES.items():
        files = sorted(glob.glob(f"{tmp_path}/in/{name}/*.parquet"))
        assert _row_groups(f"{tmp_path}/in/{name}") >= cores
        days = []
        for f in files:
            values = pq.read_table(f, columns=[timestamp]).column(timestamp).to_pylist()
            assert values == sorted(values)
            days.append((values[0].date(), values[-1].date()))
        days.sort()
        assert all(a[1] <= b[0] for a, b in zip(days, days[1:], strict=False))  # ranges meet in a day at most
        sizes = [pq.ParquetFile(f).metadata.num_rows for f in files]
        assert max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]


def test_a_hot_day_is_many_files(spark):
    from pyspark.sql import functions as F

    from ledgerlens.sources import clustered

    day = F.when(F.col("id") % 3 == 0, F.lit("2024-01-05")).otherwise(F.concat(F.lit("2024-02-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")))
    df = spark.range(8000).select(day.cast("timestamp_ntz").alias("t"), F.col("id").cast("string").alias("k"))
    sizes = [r["count"] for r in clustered(df, "t", "k").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 2 * min(sizes)


@pytest.mark.parametrize("name", sorted(REPORT_SQL))
def test_sql_reports_list_only_the_range_s_partitions(spark, tmp_path_factory, name):
    """Over inputs partitioned by day, DataFrame and SQL reports prune folders; views too."""
    base = tmp_path_factory.getbasetemp() / "by_day"
    if not base.exists():
        few = load_inputs(spark, SF_SMALL)
        made = from_frames(
            few.ledger_tx,
            few.token_transfers.where("created_at < '1995-02-01'"),
            few.contract_calls.where("created_at < '1995-02-01'"),
            few.bridge_events.where("block_timestamp < '1995-02-01'"),
        )
        store_inputs(made, str(base), "as is", by_day=True)
    inputs = stored_inputs(spark, str(base), by_day=True)
    rng = ("2024-01-03", "2024-01-09") if name.startswith("ledger") else ("1995-01-02", "1995-01-27")
    got = run_sql(spark, name, *rng, inputs=inputs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert scans and all("PartitionFilters: [isnotnull(day" in x for x in scans), plan
    expected = Dashboard(inputs, ReportParams(*rng, "week")).report(name).collect()
    assert sorted(map(str, got.collect())) == sorted(map(str, expected))
    assert expected or name == "bridge_route_totals"  # no transfer of these days prices an event of them
    register_views(inputs)
    assert sorted(map(str, run_sql(spark, name, *rng).collect())) == sorted(map(str, expected))
    if name.startswith("ledger"):
        viewed = run_sql(spark, name, *rng)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(day" in viewed
