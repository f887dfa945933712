"""Bridge events with the value of their finished transfers, in three shapes.

* :func:`bridge_sides`: the events of a range and one row of totals per hash, what the
  reports join after collapsing the events (see :mod:`ledgerlens.plans.bridge`);
* :func:`priced_bridge_events`: one row per event, with its hash's totals;
* :func:`priced_bridge_rows`: one row per event and transfer, for listing the transfers
  that priced an event.

The dashboard joins events to token transfers on ``tx_hash = split_part(id,'_',1)``
with a LEFT JOIN and then only sums ``amount_usd`` and counts distinct hashes and
senders. A hash with *k* events and *m* transfers yields *k·m* joined rows, and
``sum(amount_usd)`` over them equals, per event, the sum over its *m* transfers.

So the transfer side is aggregated to one row per hash **before** the join
(``transfer_totals``): the map-side partial aggregate collapses even a hash that
holds a third of all transfers, the join becomes many-to-one (no fan-out, no pair
explosion), and every report keeps the dashboard's numbers:

* sum over joined rows = sum over events of the hash total (NULL totals ignored);
* ``amount_usd IS NOT NULL`` on joined rows ⇔ the hash has a priced transfer
  (``priced_transfers > 0``);
* distinct counts of hashes and senders come from the event side, unchanged.

Each side is date-filtered on its own, so a transfer created after the range does
not price an event inside it. Hash text is compared as is (no case folding).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hash_part, in_date_range
from .marks import hash_marks, marked
from .routed import finished, token_transfer_amounts
from .skew import many_to_one

PRICED_EVENT_COLUMNS = (
    "event_date",
    "tx_hash",
    "source_chain",
    "destination_chain",
    "sender",
    "token_symbol",
    "transfers",
    "priced_transfers",
    "amount",
    "amount_usd",
)


def transfer_values(token_transfers: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Finished token transfers as ``(created_at, tx_hash, amount, amount_usd)``: the
    join hash and the typed values, all the bridge side needs from a transfer. With ``marks``
    (:mod:`.marks`) only those whose hash is marked, and no other's payload is read."""
    done = token_transfers.where(finished())
    if marks is not None:
        done = marked(done, marks, hash_part("id"))
    kept, v = token_transfer_amounts(done, ("amount", "amount_usd"))
    return kept.select(
        "created_at",
        hash_part("id").alias("tx_hash"),
        v["amount"].alias("amount"),
        v["amount_usd"].alias("amount_usd"),
    )


def totals_per_hash(values: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """One row per hash of :func:`transfer_values` rows created in the range: their
    count, how many carry a USD value, and the sums of amount and amount_usd (NULL
    when no transfer of the hash has a value)."""
    return (
        values.where(in_date_range("created_at", start, end))
        .groupBy("tx_hash")
        .agg(
            F.count(F.lit(1)).alias("transfers"),
            F.count("amount_usd").alias("priced_transfers"),
            F.sum("amount").alias("amount"),
            F.sum("amount_usd").alias("amount_usd"),
        )
    )


def transfer_totals(
    token_transfers: DataFrame, start: date | str, end: date | str, marks: DataFrame | None = None
) -> DataFrame:
    """Per-hash totals of the finished token transfers created in the range."""
    return totals_per_hash(transfer_values(token_transfers, marks), start, end)


def _marks(bridge_events: DataFrame, start: date | str, end: date | str, prune: bool) -> DataFrame | None:
    return hash_marks(bridge_events_in_range(bridge_events, start, end)) if prune else None


def bridge_events_in_range(bridge_events: DataFrame, start: date | str, end: date | str) -> DataFrame:
    return bridge_events.where(in_date_range("block_timestamp", start, end)).select(
        F.to_date("block_timestamp").alias("event_date"),
        "tx_hash",
        "source_chain",
        "destination_chain",
        "sender",
        "token_symbol",
    )


def priced_bridge_events(
    bridge_events: DataFrame,
    token_transfers: DataFrame,
    start: date | str,
    end: date | str,
    prune: bool = False,
) -> DataFrame:
    """Bridge events in ``[start, end]`` left-joined to per-hash transfer totals.

    One output row per event row. Unmatched events keep NULL totals and 0 counts. A hash with
    a large share of the events is split over many tasks (:mod:`.skew`). ``prune`` reads only
    the payloads of transfers that may belong to an event (:mod:`.marks`): for short ranges.
    """
    marks = _marks(bridge_events, start, end, prune)
    return price_events(bridge_events, transfer_totals(token_transfers, start, end, marks), start, end)


def price_events(bridge_events: DataFrame, totals: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Bridge events in ``[start, end]`` left-joined to per-hash ``totals``
    (:func:`transfer_totals`, or :func:`totals_per_hash` over an ingested
    transfer-values table)."""
    events = bridge_events_in_range(bridge_events, start, end)
    joined = many_to_one(events, totals, "tx_hash")
    return joined.select(
        "event_date",
        "tx_hash",
        "source_chain",
        "destination_chain",
        "sender",
        "token_symbol",
        F.coalesce(F.col("transfers"), F.lit(0)).alias("transfers"),
        F.coalesce(F.col("priced_transfers"), F.lit(0)).alias("priced_transfers"),
        "amount",
        "amount_usd",
    )


PRICED_ROW_COLUMNS = (
    "event_date",
    "tx_hash",
    "source_chain",
    "destination_chain",
    "sender",
    "token_symbol",
    "amount",
    "amount_usd",
)


def priced_bridge_rows(
    bridge_events: DataFrame,
    token_transfers: DataFrame,
    start: date | str,
    end: date | str,
    prune: bool = False,
) -> DataFrame:
    """Bridge events in ``[start, end]`` left-joined to the transfers themselves: k events
    and m transfers of one hash give k x m rows, an event without transfers gives one row
    with NULL amounts. Both sides are plain shuffles on the hash, so AQE can split a hot one.
    ``prune`` shuffles only transfers that may belong to an event (:mod:`.marks`)."""
    events = bridge_events_in_range(bridge_events, start, end)
    values = transfer_values(token_transfers, _marks(bridge_events, start, end, prune)).where(in_date_range("created_at", start, end))
    return events.join(values.select("tx_hash", "amount", "amount_usd"), on="tx_hash", how="left").select(
        *PRICED_ROW_COLUMNS
    )


@dataclass(frozen=True)
class BridgeSides:
    """The two inputs of the bridge reports: events of the range, and totals per hash."""

    events: DataFrame
    totals: DataFrame


def bridge_sides(
    bridge_events: DataFrame,
    token_transfers: DataFrame,
    start: date | str,
    end: date | str,
    prune: bool = False,
) -> BridgeSides:
    """Both sides in ``[start, end]``, narrowed to what the reports read; ``prune`` as in
    :func:`priced_bridge_events`."""
    marks = _marks(bridge_events, start, end, prune)
    totals = transfer_totals(token_transfers, start, end, marks).select("tx_hash", "amount_usd")
    return BridgeSides(bridge_events_in_range(bridge_events, start, end).drop("token_symbol"), totals)
