"""A hot key holding a third of all rows: results stay exact and nothing fans out."""

from __future__ import annotations

import json

import pytest
from conftest import ts
from pyspark.sql import functions as F

from ledgerlens.operators import bridge_sides, many_to_one, priced_bridge_events, unified_transfers
from ledgerlens.operators.skew import heavy_hitters
from ledgerlens.params import ROUTER_ADDRESSES
from ledgerlens.plans import bridge, routed

S, E = "2025-01-01", "2025-01-31"
HOT, COLD = 1500, 3000  # hot-key rows vs all other rows


@pytest.fixture
def small_skew_thresholds(spark):
    keys = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _frames(spark):
    ev = (
        spark.range(HOT + COLD)
        .select(
            F.lit(ts("2025-01-10 00:00:00")).cast("timestamp_ntz").alias("block_timestamp"),
            F.when(F.col("id") < HOT, F.lit("0xhot")).otherwise(F.concat(F.lit("0x"), F.col("id").cast("string"))).alias("tx_hash"),
            F.lit("Ethereum").alias("source_chain"),
            F.lit("osmosis").alias("destination_chain"),
            F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("sender"),
            F.lit("usdc").alias("token_symbol"),
        )
    )
    doc = json.dumps({"send": {"amount": 2, "original_source_chain": "Ethereum"}, "link": {"price": 0.5}})
    tt = spark.range(HOT + COLD).select(
        F.concat(
            F.when(F.col("id") < HOT, F.lit("0xhot")).otherwise(F.concat(F.lit("0x"), F.col("id").cast("string"))),
            F.lit("_"),
            F.col("id").cast("string"),
        ).alias("id"),
        F.lit(ts("2025-01-10 00:00:00")).cast("timestamp_ntz").alias("created_at"),
        F.lit("executed").alias("status"),
        F.lit("received").alias("simplified_status"),
        F.lit(ROUTER_ADDRESSES[0]).alias("sender_address"),
        F.when(F.col("id") < HOT, F.lit("hot-user")).otherwise(F.col("id").cast("string")).alias("recipient_address"),
        F.lit(doc).alias("data"),
    )
    return ev, tt


def test_hot_hash_does_not_fan_out(spark, small_skew_thresholds):
    ev, tt = _frames(spark)
    priced = priced_bridge_events(ev, tt, S, E)
    assert priced.count() == HOT + COLD  # one row per event, not HOT * HOT for the hot hash
    sides = bridge_sides(ev, tt, S, E)
    k = bridge.bridge_kpis(sides).collect()[0]
    # each hot event is priced by all HOT hot transfers of 1 USD; each cold one by its own
    assert (k.txn_count, k.user_count, k.volume_usd) == (1 + COLD, 7, float(HOT * HOT + COLD))
    routes = bridge.bridge_route_totals(sides).collect()
    assert [(r.txn_count, r.volume_usd) for r in routes] == [(1 + COLD, float(HOT * HOT + COLD))]


def test_hot_user_and_bucket(spark, small_skew_thresholds):
    _, tt = _frames(spark)
    cc = spark.createDataFrame([], "id string, created_at timestamp_ntz, status string, simplified_status string, data string")
    u = unified_transfers(tt, cc)
    k = routed.routed_kpis(u, S, E).collect()[0]
    assert (k.txn_count, k.user_count, k.volume_usd) == (HOT + COLD, 1 + COLD, float(HOT + COLD))
    rows = routed.routed_over_time(u, S, E, "month").collect()
    assert [(r.txn_count, r.user_count) for r in rows] == [(HOT + COLD, 1 + COLD)]


@pytest.fixture
def one_task_a_partition(spark, small_skew_thresholds):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def _rows_by_task(df):
    read = F.max(F.coalesce("transfers", F.lit(0)))  # or the join could be left out
    return sorted(r["rows"] for r in df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("rows"), read).collect())


def test_hot_hash_is_split_over_tasks(spark, one_task_a_partition):
    """A third of all events under one hash, a tenth without one: no task has much more than others."""
    rows = 9000
    hash_of = F.when(F.col("id") % 3 == 0, F.lit("0xhot")).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("0x"), F.col("id")))
    events = spark.range(rows).select(hash_of.alias("tx_hash"), F.lit("same").alias("sender"), (F.col("id") % 2).alias("side"))
    totals = spark.range(rows).select(F.concat(F.lit("0x"), F.col("id")).alias("tx_hash")).unionByName(
        spark.createDataFrame([("0xhot",)], "tx_hash string")
    )
    totals = totals.groupBy("tx_hash").agg(F.count(F.lit(1)).alias("transfers"))
    plain = events.join(totals, "tx_hash", "left")
    split = many_to_one(events, totals, "tx_hash")
    assert split.columns == plain.columns
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))
    most, median = (lambda x: (x[-1], x[len(x) // 2]))(_rows_by_task(split))
    assert most < 2.5 * median
    most, median = (lambda x: (x[-1], x[len(x) // 2]))(_rows_by_task(plain))
    assert most > 3 * median  # what it is without
    hot = {r["__hot"]: r["__salts"] for r in heavy_hitters(events, "tx_hash").collect()}
    assert set(hot) == {"0xhot", None} and hot["0xhot"] > 300
    inner = many_to_one(events, totals, "tx_hash", "inner")
    assert inner.count() == plain.where("transfers IS NOT NULL").count()


def test_many_to_one_of_nothing(spark):
    none = spark.createDataFrame([], "tx_hash string, x int")
    one = spark.createDataFrame([("a", 1)], "tx_hash string, n int")
    assert many_to_one(none, one, "tx_hash").collect() == []
    assert [tuple(r) for r in many_to_one(one, none, "tx_hash").collect()] == [("a", 1, None)]
    assert heavy_hitters(none, "tx_hash").collect() == []
    with pytest.raises(ValueError):
        many_to_one(one, none, "tx_hash", "right")
