"""Reports of any grain and range from one stored daily table of distinct sets.

Distinct counts of days do not add up to those of a week, so a table of daily counts cannot
serve other grains; a table of daily sets can. A set is kept as bitmaps: every transaction id
and address has a number, and a row of the table holds the bits of 32,768 consecutive numbers
for one day and group (``bitmap_construct_agg``). Sets of days are united with ``bitmap_or_agg`` and
counted with ``bitmap_count``, exactly, whatever the grain; a refresh reads no transaction.

Numbers are given in the order of the day a value first occurs on, so the ids of a day, most of
which occur on that day alone, lie side by side and fill few bitmaps. Values are numbered
where a range shuffle has put them, without an order over all; a number is unique and its
range's numbers are consecutive, which is all that the bitmaps need.

A hot value or day does not gather rows: values come down to one row a day and group by
map-side aggregates first. Rows without a value count nowhere, but their day and group stay
(with a count of 0), as in the row-level reports. Volumes are daily sums, added up: equal to
the row-level sums but for the rounding of doubles in another order.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import date_bucket, rounded_ratio, status_label
from ..operators import unified_transfers
from ..params import LABEL_SUCCEEDED, as_date

TX, USER = "tx", "user"


def _numbered(rows: DataFrame, day: str, keys: list[str], value: str, apart: list[str]) -> DataFrame:
    """(``apart``, ``value``, ``days``, ``number``): a row for each distinct value, with the days and
    keys it occurs on and a number by its first day; a null value's number is null."""
    values = rows.groupBy(*apart, value).agg(F.min(day).alias("first"), F.collect_set(F.struct(day, *keys)).alias("days"))
    ranged = values.repartitionByRange(*apart, "first", value).sortWithinPartitions(*apart, "first", value)
    number = F.when(F.col(value).isNotNull(), F.monotonically_increasing_id())
    return ranged.select(*apart, value, "days", number.alias("number"))


def numbers(values: DataFrame, value: str, day: str) -> DataFrame:
    """(``value``, ``number``): a number for each distinct value, by its first day."""
    return _numbered(values, day, [], value, []).where(F.col(value).isNotNull()).select(value, "number")


def daily_sets(rows: DataFrame, day: str, keys: list[str], value: str, apart: str | None = None) -> DataFrame:
    """(``day``, keys, ``part``, ``bits``): the distinct values of each day and group, as bitmaps.
    The values of each ``apart``, one of the keys, are numbered for themselves.

    The rows are read once: a value brings its days with it (a day and group once) to be
    numbered. Its numbers are dealt out by their bitmap before that is made: made first in the
    tasks that have them, most bitmaps of 4 KB would hold one bit, and be shuffled. A bitmap
    has 32,768 rows at most."""
    own = [apart] if apart else []
    others = [k for k in keys if k not in own]
    places = _numbered(rows, day, others, value, own).select(
        *own, F.inline("days"), F.bitmap_bucket_number("number").alias("part"), F.bitmap_bit_position("number").alias("place")
    )
    dealt = places.repartition(day, *keys, "part")
    return dealt.groupBy(day, *keys, "part").agg(F.bitmap_construct_agg("place").alias("bits"))


def united_counts(sets: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """(keys, ``count``): the size of the union of each group's sets.

    Bitmaps are sorted to be united, and those with few bits compress to little: of a plain
    shuffle, AQE would merge partitions by that size, to gigabytes to sort in one task. Dealt
    out to a given number of tasks, each sorts its share only."""
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.select(*keys, "part", "bits").repartition(tasks, *keys, "part")
    parts = dealt.groupBy(*keys, "part").agg(F.bitmap_or_agg("bits").alias("bits"))
    return parts.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(count))


def ledger_daily(ledger_tx: DataFrame) -> DataFrame:
    """(``measure``, ``day``, ``status``, ``part``, ``bits``): transactions by status, and senders of
    successful ones."""
    rows = ledger_tx.select(
        F.to_date("block_timestamp").alias("day"), status_label("tx_succeeded").alias("status"), "tx_id", "tx_from", "tx_succeeded"
    )
    tx = daily_sets(rows, "day", ["status"], "tx_id")
    users = daily_sets(rows.where("tx_succeeded"), "day", ["status"], "tx_from")
    columns = ["day", "status", "part", "bits"]
    return tx.select(F.lit(TX).alias("measure"), *columns).unionByName(users.select(F.lit(USER).alias("measure"), *columns))


def routed_daily(unified: DataFrame) -> DataFrame:
    """(``measure``, ``day``, ``part``, ``bits``): transfers and users of both services."""
    values = F.stack(F.lit(2), F.lit(TX), F.col("id"), F.lit(USER), F.col("user_address")).alias("measure", "value")
    rows = unified.select(F.to_date("created_at").alias("day"), values)
    return daily_sets(rows, "day", ["measure"], "value", apart="measure").select("measure", "day", "part", "bits")


def routes_daily(unified: DataFrame) -> DataFrame:
    """(``day``, chains, ``part``, ``bits``): priced transfers of each route."""
    priced = unified.where("amount_usd IS NOT NULL")
    rows = priced.select(F.to_date("created_at").alias("day"), "source_chain", "destination_chain", "id")
    return daily_sets(rows, "day", ["source_chain", "destination_chain"], "id")


def volumes_daily(unified: DataFrame) -> DataFrame:
    """(``day``, chains, ``volume``): USD of each day and route; null without a priced transfer."""
    return unified.groupBy(F.to_date("created_at").alias("day"), "source_chain", "destination_chain").agg(
        F.sum("amount_usd").alias("volume")
    )


TABLES = ("ledger", "routed", "routes", "volumes")


@dataclass(frozen=True)
class Rollups:
    """The daily tables, and the reports over them."""

    ledger: DataFrame
    routed: DataFrame
    routes: DataFrame
    volumes: DataFrame

    def ledger_kpis(self, start: date | str, end: date | str) -> DataFrame:
        return _succeeded(_on(self.ledger, start, end), []).select("txn_count", "user_count", _per_user())

    def ledger_status_over_time(self, start: date | str, end: date | str, grain: str = "week") -> DataFrame:
        tx = _on(self.ledger, start, end).where(F.col("measure") == TX).withColumn("bucket", _bucket(grain))
        return (
            united_counts(tx, ["bucket", "status"], "txn_count")
            .select("bucket", "txn_count", "status")
            .orderBy(F.col("bucket").asc_nulls_last(), "status")
        )

    def ledger_status_totals(self, start: date | str, end: date | str) -> DataFrame:
        tx = _on(self.ledger, start, end).where(F.col("measure") == TX)
        return united_counts(tx, ["status"], "txn_count")

    def ledger_users_over_time(self, start: date | str, end: date | str, grain: str = "week") -> DataFrame:
        days = _on(self.ledger, start, end).withColumn("bucket", _bucket(grain))
        counts = _succeeded(days, ["bucket"]).select("bucket", "user_count", _per_user())
        return counts.orderBy(F.col("bucket").asc_nulls_last())

    def routed_kpis(self, start: date | str, end: date | str) -> DataFrame:
        volume = _on(self.volumes, start, end).agg(_volume())
        return _beside(_measures(_on(self.routed, start, end), []), volume, []).select("txn_count", "user_count", "volume_usd")

    def routed_over_time(self, start: date | str, end: date | str, grain: str = "week") -> DataFrame:
        counts = _measures(_on(self.routed, start, end).withColumn("bucket", _bucket(grain)), ["bucket"])
        volume = _on(self.volumes, start, end).groupBy(_bucket(grain).alias("bucket")).agg(_volume())
        return (
            _beside(counts, volume, ["bucket"])
            .select("bucket", "txn_count", "user_count", "volume_usd")
            .orderBy(F.col("bucket").asc_nulls_last())
        )

    def routed_route_totals(self, start: date | str, end: date | str) -> DataFrame:
        keys = ["source_chain", "destination_chain"]
        counts = united_counts(_on(self.routes, start, end), keys, "txn_count")
        volume = _on(self.volumes, start, end).where("volume IS NOT NULL").groupBy(*keys).agg(_volume())
        return (
            _beside(counts, volume, keys)
            .select(*keys, "volume_usd", "txn_count")
            .orderBy(
                F.col("volume_usd").desc(),
                F.col("txn_count").asc(),
                F.col("source_chain").asc_nulls_last(),
                F.col("destination_chain").asc_nulls_last(),
            )
        )


def _on(table: DataFrame, start: date | str, end: date | str) -> DataFrame:
    return table.where(F.col("day").between(F.lit(as_date(start)), F.lit(as_date(end))))


def _bucket(grain: str) -> Column:
    return date_bucket("day", grain).cast("timestamp_ntz")


def _per_user() -> Column:
    return rounded_ratio("txn_count", "user_count").alias("txn_per_user")


def _volume() -> Column:
    return F.round(F.sum("volume")).alias("volume_usd")


def _beside(counts: DataFrame, volume: DataFrame, keys: list[str]) -> DataFrame:
    """Both of each group, by a union and one more aggregate: keys may be null, and a join on
    no key would be a product."""
    names = [c for c in counts.columns if c not in keys]
    left = counts.withColumn("volume_usd", F.lit(None).cast("double"))
    right = volume.select(*keys, *[F.lit(None).cast("long").alias(c) for c in names], "volume_usd")
    return left.unionByName(right).groupBy(*keys).agg(*[F.max(c).alias(c) for c in [*names, "volume_usd"]])


def _measures(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``txn_count``, ``user_count``) from sets of both measures."""
    counts = united_counts(sets, [*keys, "measure"])
    of = {m: F.coalesce(F.max(F.when(F.col("measure") == m, F.col("n"))), F.lit(0)) for m in (TX, USER)}
    return counts.groupBy(*keys).agg(of[TX].alias("txn_count"), of[USER].alias("user_count"))


def _succeeded(sets: DataFrame, keys: list[str]) -> DataFrame:
    return _measures(sets.where(F.col("status") == LABEL_SUCCEEDED), keys)


def build_rollups(inputs) -> Rollups:
    """The daily tables of the inputs, as lazy frames."""

    def unified(*columns: str) -> DataFrame:
        """With the columns that a table reads, so that no other JSON is parsed for it."""
        return unified_transfers(inputs.token_transfers, inputs.contract_calls, columns=columns)

    route = ("created_at", "source_chain", "destination_chain", "amount_usd")
    return Rollups(
        ledger_daily(inputs.ledger_tx),
        routed_daily(unified("created_at", "user_address", "id")),
        routes_daily(unified(*route, "id")),
        volumes_daily(unified(*route)),
    )


def write_rollups(rollups: Rollups, path: str) -> Rollups:
    """Store the daily tables under ``path``, clustered by day, and read them back."""
    for name in TABLES:
        table = getattr(rollups, name)
        table.repartitionByRange("day").sortWithinPartitions("day").write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
    return read_rollups(rollups.ledger.sparkSession, path)


def read_rollups(spark: SparkSession, path: str) -> Rollups:
    return Rollups(**{name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in TABLES})
