"""ledgerlens: ledger, routed-transfer and bridge reports as lazy Spark DataFrames."""

from .params import GRAINS, ReportParams
from .plans import REPORT_NAMES, Dashboard
from .sources import Inputs, from_frames, from_parquet, from_tables, load_inputs, stage_inputs

__all__ = [
    "GRAINS",
    "REPORT_NAMES",
    "Dashboard",
    "Inputs",
    "ReportParams",
    "from_frames",
    "from_parquet",
    "from_tables",
    "load_inputs",
    "stage_inputs",
]
