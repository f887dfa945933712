"""Ledger reports: transactions, users and success status over a date range.

Input: ``ledger_tx(tx_id, tx_from, tx_succeeded BOOLEAN, block_timestamp)``.
A ``tx_id`` may repeat and is counted once; distinct counts are always computed
from rows (weekly users are not a sum of daily users).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import in_date_range, rounded_ratio, share_within, status_label, time_bucket


def _in_range(ledger_tx: DataFrame, start: date | str, end: date | str) -> DataFrame:
    return ledger_tx.where(in_date_range("block_timestamp", start, end))


def _succeeded(ledger_tx: DataFrame, start: date | str, end: date | str) -> DataFrame:
    # A NULL flag is not true, so the row is dropped here (but labelled 'Failed' below).
    return _in_range(ledger_tx, start, end).where(F.col("tx_succeeded"))


def ledger_kpis(ledger_tx: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """One row: distinct successful transactions, distinct senders, rounded ratio."""
    return (
        _succeeded(ledger_tx, start, end)
        .agg(
            F.count_distinct("tx_id").alias("txn_count"),
            F.count_distinct("tx_from").alias("user_count"),
        )
        .select("txn_count", "user_count", rounded_ratio("txn_count", "user_count").alias("txn_per_user"))
    )


def _status_counts(ledger_tx: DataFrame, start: date | str, end: date | str, grain: str) -> DataFrame:
    """Distinct transactions per (bucket, status), unordered."""
    return (
        _in_range(ledger_tx, start, end)
        .select(
            time_bucket("block_timestamp", grain).alias("bucket"),
            status_label("tx_succeeded").alias("status"),
            "tx_id",
        )
        .groupBy("bucket", "status")
        .agg(F.count_distinct("tx_id").alias("txn_count"))
    )


def ledger_status_over_time(
    ledger_tx: DataFrame, start: date | str, end: date | str, grain: str = "week"
) -> DataFrame:
    """Distinct transactions per time bucket and status ('Succeeded' / 'Failed')."""
    return (
        _status_counts(ledger_tx, start, end, grain)
        .select("bucket", "txn_count", "status")
        .orderBy(F.col("bucket").asc_nulls_last(), "status")
    )


def ledger_status_share_over_time(
    ledger_tx: DataFrame, start: date | str, end: date | str, grain: str = "week"
) -> DataFrame:
    """Status counts per bucket plus each status's share of the bucket (0 when empty).

    The window runs over the grouped result (at most two rows per bucket), and the
    only sort is the final one.
    """
    counts = _status_counts(ledger_tx, start, end, grain)
    return counts.select(
        "bucket", "txn_count", "status", share_within("txn_count", "bucket").alias("share")
    ).orderBy(F.col("bucket").asc_nulls_last(), "status")


def ledger_users_over_time(
    ledger_tx: DataFrame, start: date | str, end: date | str, grain: str = "week"
) -> DataFrame:
    """Distinct senders per bucket and rounded successful transactions per sender."""
    return (
        _succeeded(ledger_tx, start, end)
        .select(time_bucket("block_timestamp", grain).alias("bucket"), "tx_id", "tx_from")
        .groupBy("bucket")
        .agg(
            F.count_distinct("tx_from").alias("user_count"),
            rounded_ratio(F.count_distinct("tx_id"), F.count_distinct("tx_from")).alias("txn_per_user"),
        )
        .orderBy(F.col("bucket").asc_nulls_last())
    )


def ledger_status_totals(ledger_tx: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Distinct transactions per status; a tx seen with both statuses counts in both."""
    return (
        _in_range(ledger_tx, start, end)
        .select(status_label("tx_succeeded").alias("status"), "tx_id")
        .groupBy("status")
        .agg(F.count_distinct("tx_id").alias("txn_count"))
    )


def ledger_status_total_share(ledger_tx: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Status totals plus each status's share of all (the donut chart's percentages).

    The grand-total window sees one partition, which is safe here: the input has at
    most two rows (one per status label).
    """
    totals = ledger_status_totals(ledger_tx, start, end)
    return totals.select("status", "txn_count", share_within("txn_count").alias("share")).orderBy("status")
