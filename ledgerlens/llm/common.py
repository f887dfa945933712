"""Helpers shared by the operators of this subpackage: scratch tables, running sums
that survive skew, and connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

T = TypeVar("T")
LIBC = ctypes.CDLL(None)

#: Rows per bucket that the bucketed windows aim at.
BUCKET_ROWS = 4096
#: A scratch table has so many files a core at most.
FILES_A_CORE = 8


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's checkpoint folder.

    ``spark.checkpoint.dir`` names it on a cluster. Only a plain local session
    (``local[...]``, one process on one machine) without that setting gets a fresh
    temporary folder; any other session without it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-llm-"))
        current = sc.getCheckpointDir()
    return current


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under :func:`scratch_dir` and read it back: cuts the
    lineage, survives lost executors, and later readers take only the columns they need.

    A task writes the partitions of its share one after another, so that many small
    partitions don't become as many small files."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    few_tasks(df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def returning_memory(batches: Iterable[T]) -> Iterator[T]:
    """``batches``, after which unused memory goes back to the system: workers outlive tasks, and idle
    ones would keep what their largest task took."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        if hasattr(LIBC, "malloc_trim"):  # glibc
            LIBC.malloc_trim(0)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs hand Python at most ``rows`` rows at a time: a bound on a task's memory
    where single rows are large. For jobs that end within it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _packed(table: np.ndarray) -> bytes:
    """Compressed, after its length: a task's table is mostly zeros, and as it is would fill the
    executors' heap, in arrays that the collector keeps apart."""
    data = table.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="lz4_raw", asbytes=True)


def _unpacked(values: pa.Buffer) -> pa.Buffer:
    return pa.decompress(values.slice(8), decompressed_size=int.from_bytes(values.slice(0, 8), "little"), codec="lz4_raw")


def summed_tables(tables: DataFrame, dtype: str, unite: Callable[[np.ndarray, np.ndarray], None]) -> DataFrame:
    """(``block``, ``values``): the tables (arrays of numbers, packed) of each ``block`` united
    in place by ``unite``, first by ``share``, then over the shares. :func:`table_values` unpacks.

    A task streams the tables it gets and holds one for each of its blocks and shares, so many
    tables of one block are no more to hold than two."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in returning_memory(batches):
            for k in range(len(batch)):
                place = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                table = np.frombuffer(_unpacked(batch.column(2)[k].as_buffer()), dtype)
                if place in held:
                    unite(held[place], table)
                else:
                    held[place] = table.copy()
        for (block, _), table in held.items():
            columns = [pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([_packed(table)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "share", "values"])

    for keys in (["block", "share"], ["block"]):
        tables = tables.repartition(*keys).mapInArrow(run, TABLE_COLUMNS)
    return tables.select("block", "values")


def table_values(values: bytes, dtype: str) -> np.ndarray:
    """The numbers of a row of :func:`summed_tables`."""
    return np.frombuffer(_unpacked(pa.py_buffer(values)), dtype)


TABLE_COLUMNS = "block int, share int, values binary"


def table_rows(table: np.ndarray, blocks: int, shares: int) -> Iterator[pa.RecordBatch]:
    """A task's whole table as rows for :func:`summed_tables`, a block each."""
    share = TaskContext.get().partitionId() % shares
    for k, part in enumerate(table.reshape(blocks, -1)):
        columns = [pa.array([k], pa.int32()), pa.array([share], pa.int32()), pa.array([_packed(part)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "share", "values"])


def few_tasks(df: DataFrame) -> DataFrame:
    """``df`` read by so many tasks a core at most, for tasks that each make a table of fixed size."""
    return df.coalesce(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


def null_safe(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Join condition on ``names`` in which nulls equal each other."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def drawn(key: Column) -> Column:
    """A long, 0 to 2^52 - 1, uniform over keys: the first 52 bits of the key's MD5."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 13), 16, 10).cast("long")


def bucket_count(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Buckets for ``rows`` rows so that each holds about ``bucket_rows``."""
    return max(1, -(-rows // bucket_rows))


def running_sum(
    df: DataFrame, group: str, bucket: str, order: Sequence[Column], value: str, out: str
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``group`` that come
    before this one in the order (``bucket``, then ``order``).

    A group may hold any share of the rows: only one bucket of it is ordered in a task;
    the buckets' totals (one row a group and bucket) give each bucket its start.
    """
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias("__total"))
    by_bucket = Window.partitionBy(group).orderBy(bucket)
    starts = totals.select(
        F.col(group).alias("__group"),
        F.col(bucket).alias("__bucket"),
        (F.sum("__total").over(by_bucket) - F.col("__total")).alias("__start"),
    )
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__before", F.coalesce(F.sum(value).over(inside), F.lit(0).cast("long")))
    joined = local.join(
        starts,
        local[group].eqNullSafe(starts["__group"]) & local[bucket].eqNullSafe(starts["__bucket"]),
    )
    return joined.withColumn(out, F.col("__start") + F.col("__before")).drop(
        "__group", "__bucket", "__start", "__before"
    )


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(``id``, ``root``) of every id in ``edges`` (columns ``a``, ``b``, both long):
    ``root`` is the smallest id reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each round is a
    few group-bys and joins on narrow rows and is written to the scratch folder.
    A hub with many edges is a skewed join key; each node's smallest neighbour is written
    before it is joined, so both sides are plain shuffles, of which AQE splits the hub's.
    """
    e = materialise(_oriented(edges.select("a", "b")))
    state = _state(e)
    for _ in range(max_rounds):
        e = materialise(_small_star(_large_star(e)))
        after = _state(e)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("a").alias("id")).distinct()
    return e.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(
        roots.select("id", F.col("id").alias("root"))
    )


def _oriented(e: DataFrame) -> DataFrame:
    return (
        e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b")).distinct()
    )


def _state(e: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(e.agg(F.count(F.lit(1)), F.sum(mixed.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(mixed, 32))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return _oriented(both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b")))


def _small_star(e: DataFrame) -> DataFrame:
    low = materialise(e.groupBy("b").agg(F.min("a").alias("m")))
    moved = e.join(low, "b")
    return _oriented(
        moved.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(moved.select(F.col("m").alias("a"), "b"))
    )
