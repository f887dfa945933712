"""Report parameters and the fixed values every report depends on."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# --- Fixed values (must equal the dashboard's for the same results) -------------------
# Time grains offered to the user; the first one is the default.
GRAINS = ("week", "month", "day")
# Default inclusive date range of the dashboard widgets.
DEFAULT_START = date(2025, 1, 1)
DEFAULT_END = date(2025, 8, 31)
# A transfer or contract call counts only when it reached these two states (exact case).
STATUS_EXECUTED = "executed"
SIMPLIFIED_STATUS_RECEIVED = "received"
# Labels of the ledger success flag.
LABEL_SUCCEEDED = "Succeeded"
LABEL_FAILED = "Failed"
# Service tags of the two branches of the unified routed-transfer dataset.
SERVICE_TOKEN_TRANSFERS = "Token Transfers"
SERVICE_CONTRACT_CALLS = "GMP"
# Router contract addresses; a row is kept when its address contains one of them,
# compared without regard to case.
ROUTER_ADDRESSES = (
    "0xce16F69375520ab01377ce7B88f5BA8C48F8D666",
    "0x492751eC3c57141deb205eC2da8bFcb410738630",
    "0xDC3D8e1Abe590BCa428a8a2FC4CfDbD1AcF57Bd9",
    "0xdf4fFDa22270c12d0b5b3788F1669D709476111E",
    "0xe6B3949F9bBF168f4E3EFc82bc8FD849868CC6d8",
)
# --- end of fixed values ---------------------------------------------------------------


def check_grain(grain: str) -> str:
    """Return ``grain`` if it is one of :data:`GRAINS`, else raise ``ValueError``.

    It names the unit that dates are truncated to, so it comes from an allow-list, never
    from free text.
    """
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}; expected one of {GRAINS}")
    return grain


def as_date(value: date | str) -> date:
    if isinstance(value, date):
        return value
    return date.fromisoformat(value)


@dataclass(frozen=True)
class ReportParams:
    """Inclusive date range plus time grain, as chosen on the dashboard."""

    start: date = DEFAULT_START
    end: date = DEFAULT_END
    grain: str = GRAINS[0]

    def __post_init__(self) -> None:
        object.__setattr__(self, "start", as_date(self.start))
        object.__setattr__(self, "end", as_date(self.end))
        check_grain(self.grain)
