"""Input tables: readers for the four dashboard sources, their stored layout, and the test-table adapter."""

from .layout import clustered, store_inputs, stored_inputs
from .tables import Inputs, from_frames, from_parquet, from_tables, normalize_flag
from .tpch_adapter import load_inputs, stage_inputs

__all__ = [
    "Inputs",
    "clustered",
    "from_frames",
    "from_parquet",
    "from_tables",
    "load_inputs",
    "normalize_flag",
    "stage_inputs",
    "store_inputs",
    "stored_inputs",
]
