"""bench.py runs end to end and prints one JSON line (smallest tables, one repeat)."""

from __future__ import annotations

import json
import os
import subprocess
import sys

from conftest import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2", BENCH_REPEATS="1")
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True, text=True, timeout=900, check=True
    ).stdout
    lines = [x for x in out.splitlines() if x.strip()]
    assert len(lines) == 1
    result = json.loads(lines[0])
    assert result["unit"] == "sec" and result["value"] > 0 and result["sf"] == 0.001
    assert {"routed_over_time", "bridge_kpis", "ledger_kpis", "dashboard_refresh"} <= set(result["queries"])
