"""Structured Streaming ingest of transfers into date-partitioned tables."""

from .ingest import (
    CONTRACT_CALL_SCHEMA,
    TOKEN_TRANSFER_SCHEMA,
    normalize_routed,
    read_transfer_values,
    read_unified,
    start_routed_ingest,
    start_transfer_values_ingest,
)

__all__ = [
    "CONTRACT_CALL_SCHEMA",
    "TOKEN_TRANSFER_SCHEMA",
    "normalize_routed",
    "read_transfer_values",
    "read_unified",
    "start_routed_ingest",
    "start_transfer_values_ingest",
]
