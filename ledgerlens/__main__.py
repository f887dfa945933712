"""Run every dashboard report once and print the rows as JSON lines.

    python -m ledgerlens --inputs /data/ledger --start 2025-01-01 --end 2025-08-31 --grain week

``--inputs`` holds the four input tables as Parquet folders (``ledger_tx``,
``token_transfers``, ``contract_calls``, ``bridge_events``); ``--tables`` reads them
from the catalog instead. Uses the active Spark session settings (submit with
``spark-submit`` on a cluster); only the report rows come back to the driver.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date, datetime

from pyspark.sql import SparkSession

from .operators.reuse import MODES
from .params import DEFAULT_END, DEFAULT_START, GRAINS, ReportParams
from .plans import REPORT_NAMES, Dashboard
from .session import configure
from .sources import from_parquet, from_tables


def _plain(value):
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return value


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m ledgerlens", description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--inputs", help="folder with the four input tables as Parquet")
    src.add_argument("--tables", action="store_true", help="read the four inputs from the catalog")
    ap.add_argument("--start", default=DEFAULT_START.isoformat())
    ap.add_argument("--end", default=DEFAULT_END.isoformat())
    ap.add_argument("--grain", default=GRAINS[0], choices=GRAINS)
    ap.add_argument("--reuse", default="none", choices=MODES)
    ap.add_argument("--shared-path", help="folder that all executors share, for --reuse parquet")
    ap.add_argument("--reports", nargs="*", default=list(REPORT_NAMES), choices=REPORT_NAMES)
    ap.add_argument("--concurrency", type=int, default=4)
    args = ap.parse_args(argv)

    spark = configure(SparkSession.builder.appName("ledgerlens").getOrCreate())
    inputs = from_tables(spark) if args.tables else from_parquet(spark, args.inputs)
    dash = Dashboard(inputs, ReportParams(args.start, args.end, args.grain), reuse=args.reuse, shared_path=args.shared_path)
    try:
        results = dash.run_all(max_concurrent=args.concurrency, names=tuple(args.reports))
    finally:
        dash.release()
    for name in args.reports:
        for row in results[name]:
            print(json.dumps({"report": name, **{k: _plain(v) for k, v in row.asDict().items()}}))
    sys.stdout.flush()
    return 0


if __name__ == "__main__":
    sys.exit(main())
