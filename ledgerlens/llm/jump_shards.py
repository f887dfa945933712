"""Sharding by jump consistent hashing (Lamping and Veach 2014).

A row's shard depends on its key and the number of shards alone; there is no ring
table. Adding a shard moves about 1/(n+1) of the rows, all of them into the new one.
Expressions only: the generator's 64-bit wrap-around product is taken in decimals.

Edge cases: a null key counts as key 0; a null text has no bytes (size 1, CRC 0);
repeated rows go to the same shard and get slots of their own; an empty table gives an
empty result. Only the named key and text columns are read, so other columns, whatever
their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, bucket_count, drawn, running_sum

# Fixed values of the published algorithm.
MULTIPLIER = 2862933555777941757
TWO_31 = 2**31
TWO_33 = 2**33
TWO_64 = 2**64


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a long key; every step jumps at least one
    shard ahead, so ``shards`` steps always suffice."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    long_key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    whole = F.lit(str(TWO_64)).cast("decimal(20,0)")
    unsigned = F.pmod(long_key.cast("decimal(20,0)") + whole, whole).cast("decimal(20,0)")
    start = F.struct(
        unsigned.alias("state"),
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("next"),
    )

    def step(acc: Column, _: Column) -> Column:
        product = (acc["state"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)")).cast("decimal(38,0)")
        # 2^64 * floor(p / 2^64) <= p: the remainder is the wrapped product.
        state = F.pmod(product + F.lit(1).cast("decimal(38,0)"), whole.cast("decimal(38,0)")).cast("decimal(20,0)")
        draw = F.floor(state / F.lit(str(TWO_33)).cast("decimal(20,0)")).cast("long") + 1
        jump = F.floor((acc["next"] + 1).cast("double") * (F.lit(float(TWO_31)) / draw.cast("double"))).cast("long")
        done = acc["next"] >= shards
        return F.struct(
            F.when(done, acc["state"]).otherwise(state).alias("state"),
            F.when(done, acc["shard"]).otherwise(acc["next"]).alias("shard"),
            F.when(done, acc["next"]).otherwise(jump).alias("next"),
        )

    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda acc: acc["shard"])
    return end.cast("int")


def assign_shards(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size`` (UTF-8 bytes + 1), ``text_crc32``,
    ``shard``, ``slot`` (gapless from 0 in the shard) and ``grown_shard`` (with one shard more).

    Slots follow a hash of the key, dealt in buckets of it: ordering one bucket of one shard
    is one task's work, and the buckets grow with the table, so no task gets a whole shard.
    """
    raw = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t"))
    rows = raw.select(
        "doc_id",
        (F.coalesce(F.octet_length("t"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("t", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    n = docs.count()
    buckets = bucket_count(n, bucket_rows * shards)
    placed = rows.select(
        "*",
        jump_hash(F.col("doc_id"), shards).alias("shard"),
        jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
        drawn(F.col("doc_id")).alias("place"),
        F.lit(1).cast("long").alias("one"),
    )
    placed = placed.withColumn("bucket", F.floor(F.col("place") / F.lit(2**52 / buckets)).cast("long"))
    order = [F.col("place"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return running_sum(placed, "shard", "bucket", order, "one", "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write every column of ``docs`` as Parquet, one ``shard=k`` folder a shard.

    A column of that name gives way to the folder's. Files are not gathered by shard, so
    no task writes a whole one."""
    docs.withColumn("shard", jump_hash(F.col(key), shards)).write.partitionBy("shard").parquet(path)
