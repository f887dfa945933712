"""Dataset-level operators: unified routed transfers, priced bridge events, reuse."""

from .bridge import (
    BridgeSides,
    bridge_events_in_range,
    bridge_sides,
    price_events,
    priced_bridge_events,
    priced_bridge_rows,
    totals_per_hash,
    transfer_totals,
    transfer_values,
)
from .marks import hash_marks, marked
from .reuse import checkpoint_dir, keep
from .routed import (
    contract_call_fee,
    contract_call_rows,
    finished,
    token_transfer_amounts,
    token_transfer_rows,
    unified_transfers,
)
from .skew import heavy_hitters, many_to_one
from .store import ResultStore, remove_folder

__all__ = [
    "BridgeSides",
    "ResultStore",
    "bridge_events_in_range",
    "bridge_sides",
    "checkpoint_dir",
    "contract_call_fee",
    "contract_call_rows",
    "finished",
    "hash_marks",
    "heavy_hitters",
    "keep",
    "many_to_one",
    "marked",
    "price_events",
    "priced_bridge_events",
    "priced_bridge_rows",
    "remove_folder",
    "token_transfer_amounts",
    "token_transfer_rows",
    "totals_per_hash",
    "transfer_totals",
    "transfer_values",
    "unified_transfers",
]
