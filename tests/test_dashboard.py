"""Dashboard runner: every reuse mode and concurrent submission give the same rows."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL

from ledgerlens import Dashboard, ReportParams, load_inputs

PARAMS = ReportParams("1995-01-01", "2024-12-31", "week")


@pytest.fixture(scope="module")
def expected(spark):
    dash = Dashboard(load_inputs(spark, SF_SMALL), PARAMS)
    return {name: df.collect() for name, df in dash.reports().items()}


@pytest.mark.parametrize("reuse", ["none", "parquet", "persist", "checkpoint"])
def test_run_all_matches_sequential(spark, expected, reuse, tmp_path):
    dash = Dashboard(load_inputs(spark, SF_SMALL), PARAMS, reuse=reuse, shared_path=str(tmp_path))
    try:
        assert dash.run_all(max_concurrent=4) == expected
    finally:
        dash.release()


def test_unknown_report(spark):
    with pytest.raises(KeyError):
        Dashboard(load_inputs(spark, SF_SMALL), PARAMS).report("nope")


def test_unknown_reuse_mode(spark):
    with pytest.raises(ValueError):
        Dashboard(load_inputs(spark, SF_SMALL), PARAMS, reuse="cache").run_all(names=("routed_kpis",))


def test_command_line_prints_every_report(spark, tmp_path, capsys):
    import json

    from ledgerlens.__main__ import main
    from ledgerlens.sources import stage_inputs

    stage_inputs(spark, SF_SMALL, str(tmp_path / "in"))
    assert main(["--inputs", str(tmp_path / "in"), "--start", "1995-01-01", "--end", "2024-12-31"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    seen = {x["report"] for x in lines}
    from ledgerlens import REPORT_NAMES

    assert seen == set(REPORT_NAMES)
    kpis = [x for x in lines if x["report"] == "routed_kpis"]
    assert len(kpis) == 1 and kpis[0]["txn_count"] > 0


def test_checkpoint_needs_a_shared_folder(tmp_path):
    """In a session without a checkpoint folder: a clear error; one set later is honoured."""
    import os
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
from ledgerlens.operators import keep
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
try:
    keep(s.range(3), "checkpoint")
    print("no error")
except ValueError as e:
    print("said:", e)
try:
    keep(s.range(3), "parquet")
except ValueError as e:
    print("said:", e)
s.sparkContext.setCheckpointDir({str(tmp_path)!r})
print("rows", keep(s.range(3), "checkpoint").count())
print("rows", keep(s.range(3), "parquet", {str(tmp_path)!r}).count())
"""
    conf = tmp_path / "conf"
    conf.mkdir()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "PYTHONPATH": root}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300).stdout
    assert "said: reuse mode 'checkpoint' needs spark.checkpoint.dir" in out
    assert "said: reuse mode 'parquet' needs the path" in out
    assert out.count("rows 3") == 2


def test_write_all(spark, expected, tmp_path):
    Dashboard(load_inputs(spark, SF_SMALL), PARAMS).write_all(str(tmp_path / "out"), names=("routed_kpis",))
    assert spark.read.parquet(str(tmp_path / "out" / "routed_kpis")).collect() == expected["routed_kpis"]
