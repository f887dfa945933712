"""Bridge reports over the two sides of :func:`ledgerlens.operators.bridge_sides`.

The left join adds no hash and no sender, so both distinct counts come from the events
alone. Events are collapsed to one row per report group and hash *before* the join (the
map-side aggregate takes in a hot or NULL hash), and a group's volume is the sum of
events x hash total. So no hash brings more than one row per group to the join, and no
Expand multiplies the joined rows. Chain names are reported as stored (no case folding).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import date_bucket
from ..operators.bridge import BridgeSides

#: Kinds of values that are counted.
HASH, SENDER = 0, 1


def _collapsed(events: DataFrame, totals: DataFrame, keys: list[str], how: str) -> DataFrame:
    """(keys, tx_hash, volume): one row per group and hash of the events."""
    per_hash = events.groupBy(*keys, "tx_hash").agg(F.count(F.lit(1)).alias("events"))
    joined = per_hash.join(totals.select("tx_hash", "amount_usd"), on="tx_hash", how=how)
    return joined.select(*keys, "tx_hash", (F.col("events") * F.col("amount_usd")).alias("volume"))


def _hashes_users_volume(sides: BridgeSides, keys: list[str], group: list[Column]) -> DataFrame:
    """Per group: distinct hashes, distinct senders and rounded volume, from one pass over the events.

    An event gives two values, its hash and its sender; they come down to one row a group and
    value with the number of events, map-side first. Hashes then meet their totals."""
    values = F.stack(F.lit(2), F.lit(HASH), F.col("tx_hash"), F.lit(SENDER), F.col("sender"))
    each = sides.events.select(*group, "tx_hash", "sender").select(*keys, values.alias("kind", "value"))
    distinct = each.groupBy(*keys, "kind", "value").agg(F.count(F.lit(1)).alias("events"))
    totals = sides.totals.select("tx_hash", "amount_usd")
    of_hash = (F.col("value") == F.col("tx_hash")) & (F.col("kind") == HASH)
    return (
        distinct.join(totals, of_hash, "left")
        .groupBy(*keys)
        .agg(
            F.count_if((F.col("kind") == HASH) & F.col("value").isNotNull()).alias("txn_count"),
            F.count_if((F.col("kind") == SENDER) & F.col("value").isNotNull()).alias("user_count"),
            F.round(F.sum(F.col("events") * F.col("amount_usd"))).alias("volume_usd"),
        )
    )


def bridge_kpis(sides: BridgeSides) -> DataFrame:
    """One row: distinct event hashes, distinct senders, rounded USD volume of matches."""
    return _hashes_users_volume(sides, [], [])


def bridge_over_time(sides: BridgeSides, grain: str = "week") -> DataFrame:
    """Per bucket of the event date: distinct hashes, distinct senders, rounded USD volume."""
    bucket = date_bucket("event_date", grain).alias("bucket")
    return _hashes_users_volume(sides, ["bucket"], [bucket]).orderBy(F.col("bucket").asc_nulls_last())


def bridge_route_totals(sides: BridgeSides) -> DataFrame:
    """Per (source, destination) chain of the event: distinct hashes and rounded USD
    volume, events with a priced transfer only; most hashes first, then smaller volume."""
    keys = ["source_chain", "destination_chain"]
    return (
        _collapsed(sides.events, sides.totals, keys, "inner")
        .where(F.col("volume").isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("txn_count"), F.round(F.sum("volume")).alias("volume_usd"))
        .orderBy(
            F.col("txn_count").desc(),
            F.col("volume_usd").asc(),
            F.col("source_chain").asc_nulls_last(),
            F.col("destination_chain").asc_nulls_last(),
        )
    )
