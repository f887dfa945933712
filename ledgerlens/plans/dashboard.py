"""All dashboard reports for one parameter set, sharing their intermediates.

The dashboard ran its ten queries one after another, each rebuilding the same
unified-transfer and priced-bridge CTEs. Here the unified transfers and the transfer
totals per hash are built once per parameter set (already restricted to the date range,
and narrowed to the columns the reports read) and optionally kept
(:func:`ledgerlens.operators.keep`), then every report reads them. Everything stays lazy
until the caller acts.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import in_date_range
from ..operators import (
    BridgeSides,
    ResultStore,
    bridge_events_in_range,
    bridge_sides,
    keep,
    remove_folder,
    totals_per_hash,
    transfer_values,
    unified_transfers,
)
from ..params import ReportParams
from ..sources import Inputs
from . import bridge, ledger, routed

REPORT_NAMES = (
    "ledger_kpis",
    "ledger_status_over_time",
    "ledger_status_share_over_time",
    "ledger_users_over_time",
    "ledger_status_totals",
    "ledger_status_total_share",
    "routed_kpis",
    "routed_over_time",
    "routed_route_totals",
    "bridge_kpis",
    "bridge_over_time",
    "bridge_route_totals",
)


@dataclass
class Dashboard:
    """Lazily built reports of one parameter set over one set of inputs."""

    inputs: Inputs
    params: ReportParams = field(default_factory=ReportParams)
    reuse: str = "none"
    #: Folder shared by all executors, for ``reuse="parquet"`` and ``"store"``.
    shared_path: str | None = None
    _unified: DataFrame | None = None
    _bridge: BridgeSides | None = None
    _store: ResultStore | None = None
    _own_path: str | None = None

    def __post_init__(self) -> None:
        # A store's entries are by the whole tables' files, and by day: it gets whole inputs.
        self._whole = self.inputs
        self.inputs = self.inputs.between(self.params.start, self.params.end)
        if self.reuse == "store":
            if not self.shared_path:
                raise ValueError("reuse mode 'store' needs the path of a shared folder")
            self._store = ResultStore(self.inputs.ledger_tx.sparkSession, self.shared_path)

    def _keep(self, df: DataFrame) -> DataFrame:
        if self.reuse == "parquet" and self.shared_path and not self._own_path:
            self._own_path = f"{self.shared_path.rstrip('/')}/refresh-{uuid.uuid4().hex}"
        return keep(df, self.reuse, self._own_path or self.shared_path)

    def _unified_rows(self, start, end) -> DataFrame:
        rows = unified_transfers(
            self.inputs.token_transfers, self.inputs.contract_calls, columns=routed.REPORT_COLUMNS
        )
        return rows.where(in_date_range("created_at", start, end))

    @property
    def unified(self) -> DataFrame:
        if self._unified is None:
            p = self.params
            if self._store:
                sources = [self._whole.token_transfers, self._whole.contract_calls]
                self._unified = self._store.rows("unified", sources, "created_at", p.start, p.end, self._unified_rows)
            else:
                self._unified = self._keep(self._unified_rows(p.start, p.end))
        return self._unified

    def _values(self, start, end) -> DataFrame:
        return transfer_values(self.inputs.token_transfers).where(in_date_range("created_at", start, end))

    @property
    def bridge(self) -> BridgeSides:
        if self._bridge is None:
            p = self.params
            if self._store:
                sources = [self._whole.token_transfers]
                values = self._store.rows("transfer_values", sources, "created_at", p.start, p.end, self._values)
                events = bridge_events_in_range(self.inputs.bridge_events, p.start, p.end).drop("token_symbol")
                totals = totals_per_hash(values, p.start, p.end).select("tx_hash", "amount_usd")
                self._bridge = BridgeSides(events, totals)
            else:
                sides = bridge_sides(self.inputs.bridge_events, self.inputs.token_transfers, p.start, p.end)
                self._bridge = BridgeSides(sides.events, self._keep(sides.totals))
        return self._bridge

    def _entry(self, name: str) -> tuple[dict[str, str], list[DataFrame]]:
        """The parameters and sources that a report's rows depend on."""
        params = {"start": str(self.params.start), "end": str(self.params.end)}
        if name.endswith("_over_time"):
            params["grain"] = self.params.grain
        whole = self._whole
        sources = {
            "ledger": [whole.ledger_tx],
            "routed": [whole.token_transfers, whole.contract_calls],
            "bridge": [whole.bridge_events, whole.token_transfers],
        }
        return params, sources[name.split("_")[0]]

    def report(self, name: str) -> DataFrame:
        """A report; with ``reuse="store"``, its stored rows, in their order."""
        if name not in REPORT_NAMES:
            raise KeyError(f"unknown report {name!r}; expected one of {REPORT_NAMES}")
        if not self._store:
            return self._report(name)
        params, sources = self._entry(name)
        stored = self._store.result(name, params, sources, lambda: self._report(name).coalesce(1))
        return _ordered(name, stored)

    def _report(self, name: str) -> DataFrame:
        p, tx = self.params, self.inputs.ledger_tx
        builders = {
            "ledger_kpis": lambda: ledger.ledger_kpis(tx, p.start, p.end),
            "ledger_status_over_time": lambda: ledger.ledger_status_over_time(tx, p.start, p.end, p.grain),
            "ledger_status_share_over_time": lambda: ledger.ledger_status_share_over_time(
                tx, p.start, p.end, p.grain
            ),
            "ledger_users_over_time": lambda: ledger.ledger_users_over_time(tx, p.start, p.end, p.grain),
            "ledger_status_totals": lambda: ledger.ledger_status_totals(tx, p.start, p.end),
            "ledger_status_total_share": lambda: ledger.ledger_status_total_share(tx, p.start, p.end),
            "routed_kpis": lambda: routed.routed_kpis(self.unified, p.start, p.end),
            "routed_over_time": lambda: routed.routed_over_time(self.unified, p.start, p.end, p.grain),
            "routed_route_totals": lambda: routed.routed_route_totals(self.unified, p.start, p.end),
            "bridge_kpis": lambda: bridge.bridge_kpis(self.bridge),
            "bridge_over_time": lambda: bridge.bridge_over_time(self.bridge, p.grain),
            "bridge_route_totals": lambda: bridge.bridge_route_totals(self.bridge),
        }
        return builders[name]()

    def reports(self) -> dict[str, DataFrame]:
        return {name: self.report(name) for name in REPORT_NAMES}

    def run_all(self, max_concurrent: int = 4, names: tuple[str, ...] = REPORT_NAMES) -> dict[str, list[Row]]:
        """Run reports as concurrent Spark jobs and return their rows.

        Results have one row, one per bucket or one per route; routes are free text, so
        where their number is not known to be small, use :meth:`write_all`. Submitting the jobs together lets the
        scheduler fill idle executor slots with the next report's tasks while one
        report waits on a shuffle. Kept intermediates are materialised first, so
        concurrent reports share them instead of each computing them.
        """
        if self.reuse == "persist":
            if any(n.startswith("routed") for n in names):
                self.unified.count()
            if any(n.startswith("bridge") for n in names):
                self.bridge.totals.count()
        frames = {name: self.report(name) for name in names}
        with ThreadPoolExecutor(max_workers=max(1, max_concurrent)) as pool:
            futures = {name: pool.submit(df.collect) for name, df in frames.items()}
            return {name: f.result() for name, f in futures.items()}

    def write_all(self, path: str, names: tuple[str, ...] = REPORT_NAMES) -> None:
        """Write each report as Parquet under ``path``; nothing comes to the driver."""
        for name in names:
            self.report(name).write.parquet(f"{path.rstrip('/')}/{name}")

    def release(self) -> None:
        """Drop kept intermediates: unpersist persisted ones; remove the files of ``"parquet"``; drop the
        references to checkpointed ones so the context cleaner can remove their files (with
        ``spark.cleaner.referenceTracking.cleanCheckpoints``). A store's entries stay for the next
        refresh: :meth:`evict` removes those that are outdated."""
        for df in (self._unified, self._bridge and self._bridge.totals):
            if df is not None and self.reuse == "persist":
                df.unpersist()
        if self._own_path:
            remove_folder(self.inputs.ledger_tx.sparkSession, self._own_path)
        self._unified = self._bridge = self._own_path = None

    def evict(self) -> int:
        """Remove the store's entries of other parameters, and of input files as they were
        before; returns how many folders went."""
        if not self._store:
            return 0
        whole = self._whole
        datasets = {"unified": [whole.token_transfers, whole.contract_calls], "transfer_values": [whole.token_transfers]}
        gone = [self._store.evict(name, [({}, sources)]) for name, sources in datasets.items()]
        return sum(gone) + sum(self._store.evict(name, [self._entry(name)]) for name in REPORT_NAMES)


def _ordered(name: str, stored: DataFrame) -> DataFrame:
    """A stored report in the report's order (it has a row a bucket or route)."""
    bucket, source, destination = (F.col(c).asc_nulls_last() for c in ("bucket", "source_chain", "destination_chain"))
    order = {
        "ledger_status_over_time": [bucket, F.col("status")],
        "ledger_status_share_over_time": [bucket, F.col("status")],
        "ledger_users_over_time": [bucket],
        "ledger_status_total_share": [F.col("status")],
        "routed_over_time": [bucket],
        "routed_route_totals": [F.col("volume_usd").desc(), F.col("txn_count"), source, destination],
        "bridge_over_time": [bucket],
        "bridge_route_totals": [F.col("txn_count").desc(), F.col("volume_usd"), source, destination],
    }
    return stored.orderBy(*order[name]) if name in order else stored
