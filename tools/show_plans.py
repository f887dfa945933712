"""Print the formatted physical plan of reports over stored inputs.

    python tools/show_plans.py [staged_dir] [report ...]

With no ``staged_dir`` the inputs are staged from /root/testdata/sf0.01 into a new
temporary folder first. Broadcast joins are switched off so the plans show what a
large table gets (sort-merge join, shuffles); nothing is executed.
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens import REPORT_NAMES, Dashboard, ReportParams  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402
from ledgerlens.sources import from_parquet, stage_inputs  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    spark = local_session()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    if args and os.path.isdir(args[0]):
        inputs, args = from_parquet(spark, args[0]), args[1:]
    else:
        inputs = stage_inputs(spark, "/root/testdata/sf0.01", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    for name in args or REPORT_NAMES:
        rng = ("2024-01-01", "2024-01-31") if name.startswith("ledger") else ("1995-01-01", "2001-12-31")
        print(f"===== {name}")
        Dashboard(inputs, ReportParams(*rng, "week")).report(name).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
