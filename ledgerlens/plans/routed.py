"""Routed-transfer reports over the unified dataset (token transfers + contract calls).

Input: the output of :func:`ledgerlens.operators.unified_transfers`. The date range
is applied here, above the union; Catalyst pushes it into both branches.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import in_date_range, time_bucket
from ..operators.routed import UNIFIED_COLUMNS

#: Kinds of values that are counted.
ID, USER = 0, 1

#: Columns of the unified dataset that each report reads (of it, only their JSON leaves
#: are parsed: pass them to :func:`ledgerlens.operators.unified_transfers`).
COLUMNS = {
    "routed_kpis": ("created_at", "user_address", "amount_usd", "id"),
    "routed_over_time": ("created_at", "user_address", "amount_usd", "id"),
    "routed_route_totals": ("created_at", "source_chain", "destination_chain", "amount_usd", "id"),
}
#: Those of all three.
REPORT_COLUMNS = ("created_at", "source_chain", "destination_chain", "user_address", "amount_usd", "id")


def columns_of(report: str) -> tuple[str, ...]:
    return COLUMNS.get(report, UNIFIED_COLUMNS)


def _in_range(unified: DataFrame, start: date | str, end: date | str) -> DataFrame:
    return unified.where(in_date_range("created_at", start, end))


def _ids_users_volume(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: distinct ids, distinct users and rounded volume, from one pass over the rows.

    Two distinct counts and a sum in one aggregate would make three rows of each (an Expand).
    Here a row gives two values, its id with the amount and its user; they come down to one row
    a group and value, map-side first, and are then counted."""
    values = F.stack(
        F.lit(2), F.lit(ID), F.col("id"), F.col("amount_usd"), F.lit(USER), F.col("user_address"), F.lit(None).cast("double")
    )
    each = rows.select(*keys, values.alias("kind", "value", "amount_usd"))
    distinct = each.groupBy(*keys, "kind", "value").agg(F.sum("amount_usd").alias("amount_usd"))
    return distinct.groupBy(*keys).agg(
        F.count_if((F.col("kind") == ID) & F.col("value").isNotNull()).alias("txn_count"),
        F.count_if((F.col("kind") == USER) & F.col("value").isNotNull()).alias("user_count"),
        F.round(F.sum("amount_usd")).alias("volume_usd"),
    )


def routed_kpis(unified: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """One row: distinct transfer ids and users across both services, rounded USD volume."""
    return _ids_users_volume(_in_range(unified, start, end), [])


def routed_over_time(
    unified: DataFrame, start: date | str, end: date | str, grain: str = "week"
) -> DataFrame:
    """Per time bucket: distinct transfers, distinct users, rounded USD volume."""
    rows = _in_range(unified, start, end).select(
        time_bucket("created_at", grain).alias("bucket"), "id", "user_address", "amount_usd"
    )
    return _ids_users_volume(rows, ["bucket"]).orderBy(F.col("bucket").asc_nulls_last())


def routed_route_totals(unified: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Per (source, destination) chain: rounded USD volume and distinct transfers, priced
    transfers only; largest volume first, then fewer transfers first."""
    return (
        _in_range(unified, start, end)
        .where(F.col("amount_usd").isNotNull())
        .groupBy("source_chain", "destination_chain")
        .agg(
            F.round(F.sum("amount_usd")).alias("volume_usd"),
            F.count_distinct("id").alias("txn_count"),
        )
        .orderBy(
            F.col("volume_usd").desc(),
            F.col("txn_count").asc(),
            F.col("source_chain").asc_nulls_last(),
            F.col("destination_chain").asc_nulls_last(),
        )
    )
