"""Column-level helpers (pure ``Column -> Column`` functions)."""

from .columns import (
    contains_any_ci,
    date_bucket,
    hash_part,
    in_date_range,
    rounded_ratio,
    safe_double,
    share_within,
    status_label,
    time_bucket,
)
from .json_paths import json_leaves, leaf_schema, with_leaves

__all__ = [
    "contains_any_ci",
    "date_bucket",
    "hash_part",
    "in_date_range",
    "json_leaves",
    "leaf_schema",
    "rounded_ratio",
    "safe_double",
    "share_within",
    "status_label",
    "time_bucket",
    "with_leaves",
]
