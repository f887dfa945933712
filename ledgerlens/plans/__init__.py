"""Report plans: the ledger, routed-transfer and bridge reports, and the dashboard runner."""

from . import bridge, ledger, routed
from .dashboard import REPORT_NAMES, Dashboard

__all__ = ["REPORT_NAMES", "Dashboard", "bridge", "ledger", "routed"]
