"""Reuse of a shared intermediate across several reports.

The dashboard cached each query result by its parameters. Here the shared inputs
of several reports (the unified transfers of one date range, the transfer totals per
hash) can be kept so they are computed once per parameter set:

* ``parquet``: written under a folder that the caller names and that all executors share,
  and read back column by column;
* ``persist``: executor memory, spilling to disk; blocks lost with an executor are
  recomputed from lineage, so it survives executor loss;
* ``checkpoint``: written to the cluster's shared checkpoint folder and read
  back, cutting the lineage (never a machine-local folder, never a local checkpoint).
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
MODES = ("none", "parquet", "persist", "checkpoint")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder set by ``spark.checkpoint.dir`` or ``SparkContext.setCheckpointDir``."""
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        raise ValueError(
            f"reuse mode 'checkpoint' needs {CHECKPOINT_CONF} (or SparkContext.setCheckpointDir): "
            "a folder that the driver and all executors share"
        )
    return current


def keep(df: DataFrame, mode: str = "persist", path: str | None = None) -> DataFrame:
    """Keep ``df`` for reuse: ``"parquet"`` (under the shared folder ``path``), ``"persist"``
    (memory+disk), ``"checkpoint"`` (shared storage, lineage cut) or ``"none"``."""
    if mode == "none":
        return df
    if mode == "parquet":
        if not path:
            raise ValueError("reuse mode 'parquet' needs the path of a shared folder")
        table = f"{path.rstrip('/')}/kept-{uuid.uuid4().hex}"
        df.write.parquet(table)
        return df.sparkSession.read.schema(df.schema).parquet(table)
    if mode == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if mode == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    raise ValueError(f"unknown reuse mode {mode!r}; expected one of {MODES}")
