"""The four input tables, read from a catalog or from Parquet.

Only column *names* are fixed; readers select just the columns the reports use so
that the Parquet scan reads nothing else (``ReadSchema`` in ``explain``).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import as_date

LEDGER_TX_COLUMNS = ("tx_id", "tx_from", "tx_succeeded", "block_timestamp")
TOKEN_TRANSFER_COLUMNS = (
    "id",
    "created_at",
    "status",
    "simplified_status",
    "sender_address",
    "recipient_address",
    "data",
)
CONTRACT_CALL_COLUMNS = ("id", "created_at", "status", "simplified_status", "data")
BRIDGE_EVENT_COLUMNS = (
    "block_timestamp",
    "tx_hash",
    "source_chain",
    "destination_chain",
    "sender",
    "token_symbol",
)


@dataclass(frozen=True)
class Inputs:
    """The four source tables of the dashboard.

    ``date_columns`` names, per input, a DATE column that holds the day of its timestamp
    (as tables partitioned by day have); ``dated`` holds those inputs with that column."""

    ledger_tx: DataFrame
    token_transfers: DataFrame
    contract_calls: DataFrame
    bridge_events: DataFrame
    date_columns: Mapping[str, str] = field(default_factory=dict)
    dated: Mapping[str, DataFrame] = field(default_factory=dict)

    def between(self, start: date | str, end: date | str) -> Inputs:
        """The same inputs, those with a date column restricted to its range (inclusive), so
        that only the partitions of these days are listed and read."""
        kept = {}
        for name, column in self.date_columns.items():
            days = F.col(column).between(F.lit(as_date(start)), F.lit(as_date(end)))
            kept[name] = self.dated[name].where(days).select(*getattr(self, name).columns)
        return replace(self, **kept)


def _require(df: DataFrame, name: str, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} is missing columns {missing}")
    return df.select(*columns)


def normalize_flag(df: DataFrame, column: str = "tx_succeeded") -> DataFrame:
    """Make the success flag a BOOLEAN.

    A boolean column is kept as is (true / false / NULL). A text column follows a
    text comparison with ``'TRUE'``: exactly ``TRUE`` is true, NULL stays NULL and
    any other text is false.
    """
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.BooleanType):
        return df
    c = F.col(column)
    return df.withColumn(column, F.when(c.isNull(), F.lit(None)).otherwise(c == F.lit("TRUE")))


def from_frames(
    ledger_tx: DataFrame,
    token_transfers: DataFrame,
    contract_calls: DataFrame,
    bridge_events: DataFrame,
    date_columns: Mapping[str, str] | None = None,
) -> Inputs:
    """Validate and narrow four DataFrames to the columns the reports read.

    ``date_columns`` may name a partition column per input (see :class:`Inputs`)."""
    raw = {
        "ledger_tx": (ledger_tx, LEDGER_TX_COLUMNS),
        "token_transfers": (token_transfers, TOKEN_TRANSFER_COLUMNS),
        "contract_calls": (contract_calls, CONTRACT_CALL_COLUMNS),
        "bridge_events": (bridge_events, BRIDGE_EVENT_COLUMNS),
    }
    days = dict(date_columns or {})
    if unknown := set(days) - set(raw):
        raise ValueError(f"no such inputs: {sorted(unknown)}")

    def narrowed(name: str, *more: str) -> DataFrame:
        df, columns = raw[name]
        df = _require(df, name, (*columns, *(c for c in more if c not in columns)))
        return normalize_flag(df) if name == "ledger_tx" else df

    return Inputs(
        **{name: narrowed(name) for name in raw},
        date_columns=days,
        dated={name: narrowed(name, column) for name, column in days.items()},
    )


def from_tables(
    spark: SparkSession,
    ledger_tx: str = "ledger_tx",
    token_transfers: str = "token_transfers",
    contract_calls: str = "contract_calls",
    bridge_events: str = "bridge_events",
    date_columns: Mapping[str, str] | None = None,
) -> Inputs:
    """Read the inputs from catalog tables (or temp views) by name."""
    return from_frames(
        spark.table(ledger_tx),
        spark.table(token_transfers),
        spark.table(contract_calls),
        spark.table(bridge_events),
        date_columns,
    )


def from_parquet(spark: SparkSession, base: str, date_columns: Mapping[str, str] | None = None) -> Inputs:
    """Read ``{base}/{ledger_tx,token_transfers,contract_calls,bridge_events}`` Parquet."""
    base = base.rstrip("/")
    return from_frames(
        spark.read.parquet(f"{base}/ledger_tx"),
        spark.read.parquet(f"{base}/token_transfers"),
        spark.read.parquet(f"{base}/contract_calls"),
        spark.read.parquet(f"{base}/bridge_events"),
        date_columns,
    )
