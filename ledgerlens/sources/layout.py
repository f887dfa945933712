"""Stored layout of the inputs: files of bounded size, clustered by day.

A report reads a range of days, so rows of one day should lie together: then the row groups'
minimum and maximum timestamps skip what lies outside the range, and a table that is also
partitioned by day lists only the range's folders. And a report's work is per row, so a table
needs at least as many files as the cluster runs tasks at once, or cores stay idle.

:func:`clustered` deals rows out by ranges of their day. Within a day they are ordered by a
hash of the row's key columns, so a day that holds a third of all rows is many ranges.
:func:`store_inputs` writes any :class:`Inputs` in that layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Inputs, from_parquet

#: Rows of a file at most, about (with JSON payloads some 100 to 300 MB).
ROWS_A_FILE = 1 << 20
#: Timestamp and key of each input.
TIMES = {"ledger_tx": "block_timestamp", "token_transfers": "created_at", "contract_calls": "created_at", "bridge_events": "block_timestamp"}
KEYS = {"ledger_tx": "tx_id", "token_transfers": "id", "contract_calls": "id", "bridge_events": "tx_hash"}
DAY = "day"
DATA_TYPES = ("variant", "string", "as is")


def file_count(spark: SparkSession, rows: int, rows_a_file: int = ROWS_A_FILE) -> int:
    """Files for ``rows`` rows: of bounded size, and one for each task that can run at once."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_a_file))


def clustered(df: DataFrame, timestamp: str, *keys: str, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """``df`` dealt out by ranges of the day of ``timestamp``, in order of time within each.

    The rows are counted first; a range shuffle samples them, so give it stored columns and
    make costly ones (JSON, VARIANT) from its result."""
    files = file_count(df.sparkSession, df.count(), rows_a_file)
    ranged = df.repartitionByRange(files, F.to_date(timestamp), F.xxhash64(timestamp, *keys))
    return ranged.sortWithinPartitions(timestamp)


def as_variant(df: DataFrame, data_type: str) -> DataFrame:
    """JSON text in ``data`` parsed to VARIANT (malformed text becomes null), if asked for."""
    if data_type not in DATA_TYPES:
        raise ValueError(f"data_type must be one of {DATA_TYPES}, not {data_type!r}")
    if data_type == "variant" and "data" in df.columns and df.schema["data"].dataType.typeName() == "string":
        return df.withColumn("data", F.try_parse_json("data"))
    return df


def write_table(df: DataFrame, path: str, timestamp: str, by_day: bool = False) -> None:
    """Write ``df``, as it is dealt out, as Parquet; ``by_day`` adds a folder a day."""
    writer = df.withColumn(DAY, F.to_date(timestamp)).write.partitionBy(DAY) if by_day else df.write
    writer.mode("overwrite").parquet(path)


def store_inputs(inputs: Inputs, out_dir: str, data_type: str = "variant", by_day: bool = False) -> Inputs:
    """Write the four inputs clustered by day under ``out_dir`` (on storage that the cluster
    shares) and read them back. ``data_type`` ``"variant"`` parses JSON text once here, after
    the shuffle; ``"as is"`` keeps the payload. With ``by_day`` each is partitioned by its day,
    and reports of a range list only the range's folders (:meth:`Inputs.between`)."""
    out_dir = out_dir.rstrip("/")
    for name, timestamp in TIMES.items():
        df = clustered(getattr(inputs, name), timestamp, KEYS[name])
        write_table(as_variant(df, data_type), f"{out_dir}/{name}", timestamp, by_day)
    return stored_inputs(inputs.ledger_tx.sparkSession, out_dir, by_day)


def stored_inputs(spark: SparkSession, out_dir: str, by_day: bool = False) -> Inputs:
    return from_parquet(spark, out_dir, {name: DAY for name in TIMES} if by_day else None)
