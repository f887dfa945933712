"""Build the four dashboard inputs from the TPC-H-like test tables.

The test tables (``events``, ``lineitem``, ``orders``) have no ledger schema, so
each input is derived from one of them with narrow, per-row Spark expressions
(no joins, no shuffles): work grows linearly with the tables and stays inside
one codegen stage per scan.

| input             | from       | row rule                                              |
| ----------------- | ---------- | ----------------------------------------------------- |
| `ledger_tx`       | `events`   | ``tx_id = event_id div 3`` (repeats, mixed statuses)  |
| `token_transfers` | `lineitem` | ``id = 0x<orderkey>_<linenumber>`` (duplicates kept)  |
| `contract_calls`  | `orders`   | ``id = 0x<orderkey>_<custkey mod 9 + 1>``             |
| `bridge_events`   | `orders`   | ``tx_hash = 0x<orderkey>``                            |

``data`` is JSON text whose leaves take every JSON kind (number, numeric text,
array, object, boolean, other text, null, absent, malformed document), so the
extraction rules of the reports are exercised on the whole table. The same rules
are restated, independently and without JSON, in the DuckDB oracle
(``oracle_queries.py``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import ROUTER_ADDRESSES
from .layout import TIMES, as_variant, clustered, stored_inputs, write_table
from .tables import LEDGER_TX_COLUMNS, Inputs, _require, from_frames, normalize_flag

# Design values of this adapter (chain and token names are invented test labels).
TRANSFER_SOURCE_CHAINS = ("Ethereum", "ethereum", "Polygon", "Arbitrum", "AVALANCHE", "binance")
TRANSFER_DEST_CHAINS = ("osmosis", "Moonbeam", "fantom", "Celo", "kava")
BRIDGE_SOURCE_CHAINS = ("Ethereum", "ethereum", "BSC", "Polygon", "Arbitrum", "Avalanche", "polygon")
BRIDGE_DEST_CHAINS = ("osmosis", "cosmoshub", "Kava", "moonbeam")
ASSET_BY_RETURNFLAG = {"A": "usdc", "N": "weth", "R": "wbtc"}
OTHER_ADDRESS = "0x1111111111111111111111111111111111111111"


def _pick(values: tuple[str, ...], key: Column) -> Column:
    """``values[key mod len(values)]`` as a literal array lookup."""
    idx = (F.pmod(key, F.lit(len(values))) + F.lit(1)).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx)


# --- tiny JSON text builders (per-row string concatenation, JVM side) ---------------


def _num(c: Column) -> Column:
    """JSON number text of a double (Java's shortest round-trip form)."""
    return c.cast("double").cast("string")


def _text(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _obj(*pairs: tuple[str, Column]) -> Column:
    """``{"k":v,...}``; a pair whose value text is NULL is left out (absent key)."""
    members = [F.concat(F.lit(f'"{k}":'), v) for k, v in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


# --- the four inputs ------------------------------------------------------------------


def ledger_tx_from_events(events: DataFrame) -> DataFrame:
    user = F.col("user_id")
    return events.select(
        F.expr("event_id div 3").cast("string").alias("tx_id"),
        F.when(F.pmod(user, F.lit(41)) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("acct"), user.cast("string")))
        .alias("tx_from"),
        F.when(F.col("event_type") == "error", F.lit(False))
        .when((F.col("event_type") == "signup") & (F.pmod(user, F.lit(7)) == 0), F.lit(None))
        .otherwise(F.lit(True))
        .alias("tx_succeeded"),
        F.col("ts").alias("block_timestamp"),
    )


def _router_address(key: Column, n_slots: int) -> Column:
    """One of the router addresses (case varied, sometimes inside longer text), another
    address, or NULL, chosen by ``key mod n_slots``; ``n_slots`` must be >= 8."""
    slot = F.pmod(key, F.lit(n_slots))
    out = F.when(slot == 0, F.lit(ROUTER_ADDRESSES[0]))
    out = out.when(slot == 1, F.lit(ROUTER_ADDRESSES[1].lower()))
    out = out.when(slot == 2, F.lit(ROUTER_ADDRESSES[2].upper()))
    out = out.when(slot == 3, F.lit(ROUTER_ADDRESSES[3]))
    out = out.when(slot == 4, F.lit("eth:" + ROUTER_ADDRESSES[4].lower() + ":v2"))
    out = out.when(slot == 5, F.lit(OTHER_ADDRESS))
    out = out.when(slot == 6, F.lit(None).cast("string"))
    return out.otherwise(F.lit(ROUTER_ADDRESSES[4]))


def token_transfers_from_lineitem(lineitem: DataFrame) -> DataFrame:
    ok, ln, pk = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    qty = F.col("l_quantity").cast("double")
    flag, lstatus = F.col("l_returnflag"), F.col("l_linestatus")
    # Dyadic prices (multiples of 1/64): integer amount x price and sums of such
    # products are exact in binary floating point, whatever the summation order.
    price = F.floor(F.sqrt(pk.cast("double") + F.lit(1.0)) * F.lit(16.0)).cast("double") / F.lit(64.0)

    amount = (
        F.when(ln <= 3, _num(qty))
        .when(ln == 4, _text(_num(qty)))
        .when(ln == 5, F.concat(F.lit("["), _num(qty), F.lit("]")))
        .when(ln == 6, _obj(("value", _num(qty))))
        .when(F.pmod(ok, F.lit(2)) == 0, F.lit("true"))
        .otherwise(F.lit('"n/a"'))
    )
    price_json = (
        F.when(F.pmod(pk, F.lit(13)) == 0, F.lit(None).cast("string"))
        .when(F.pmod(pk, F.lit(13)) == 1, _text(_num(price)))
        .when(F.pmod(pk, F.lit(13)) == 2, F.lit("null"))
        .otherwise(_num(price))
    )
    fee_value = F.col("l_tax") * qty
    fee_json = F.when(F.col("l_discount") >= 0.09, F.concat(F.lit("["), _num(fee_value), F.lit("]"))).otherwise(
        _num(fee_value)
    )
    asset = F.lit(None).cast("string")
    for k, v in ASSET_BY_RETURNFLAG.items():
        asset = F.when(flag == k, F.lit(v)).otherwise(asset)
    doc = _obj(
        (
            "send",
            _obj(
                ("original_source_chain", _text(_pick(TRANSFER_SOURCE_CHAINS, pk))),
                ("original_destination_chain", _text(_pick(TRANSFER_DEST_CHAINS, ok))),
                ("amount", amount),
                ("fee_value", fee_json),
            ),
        ),
        ("link", _obj(("price", price_json), ("asset", _text(asset)))),
    )
    malformed = (F.pmod(ok, F.lit(97)) == 0) & (ln == 2)
    data = F.when(malformed, F.lit('{"send":{"amount":')).otherwise(doc)

    status = (
        F.when((lstatus == "O") & (flag == "R"), F.lit("Executed"))
        .when((lstatus == "O") & (flag == "A"), F.lit("pending"))
        .otherwise(F.lit("executed"))
    )
    simplified = F.when((lstatus == "O") & (flag == "N"), F.lit("sent")).otherwise(F.lit("received"))
    return lineitem.select(
        F.concat(F.lit("0x"), ok.cast("string"), F.lit("_"), ln.cast("string")).alias("id"),
        F.col("l_shipdate").alias("created_at"),
        status.alias("status"),
        simplified.alias("simplified_status"),
        _router_address(F.col("l_suppkey"), 8).alias("sender_address"),
        F.concat(F.lit("acct"), pk.cast("string")).alias("recipient_address"),
        data.alias("data"),
    )


def contract_calls_from_orders(orders: DataFrame) -> DataFrame:
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    total = F.col("o_totalprice").cast("double")
    value = F.sqrt(total) * F.lit(10.0)
    value_json = (
        F.when(F.pmod(ok, F.lit(17)) == 0, _obj(("usd", _num(value))))
        .when(F.pmod(ok, F.lit(23)) == 0, F.lit(None).cast("string"))
        .when(F.col("o_orderstatus") == "O", _text(_num(value)))
        .otherwise(_num(value))
    )
    amount_json = F.when(F.pmod(ok, F.lit(10)) == 0, F.lit(None).cast("string")).otherwise(
        _num(total / F.lit(1000.0))
    )
    gas_used = (F.lit(21000) + F.pmod(ck, F.lit(1000))).cast("double")
    gas_json = (
        F.when(F.pmod(ok, F.lit(4)) == 0, F.lit(None).cast("string"))
        .when(F.pmod(ok, F.lit(4)) == 1, F.concat(F.lit("["), _num(gas_used), F.lit("]")))
        .otherwise(_num(gas_used))
    )
    token_usd = F.sqrt((F.pmod(ck, F.lit(50)) + F.lit(1)).cast("double")) / F.lit(1000.0)
    token_usd_json = F.when(F.pmod(ck, F.lit(9)) == 0, F.lit(None).cast("string")).otherwise(_num(token_usd))
    express_json = F.when(F.pmod(ok, F.lit(3)) == 0, F.lit(None).cast("string")).otherwise(
        _num(total / F.lit(5000.0))
    )
    symbol = F.concat(F.lit("tok"), F.substring(F.col("o_orderpriority"), 1, 1))
    doc = _obj(
        (
            "call",
            _obj(
                ("chain", _text(_pick(TRANSFER_SOURCE_CHAINS, ck))),
                ("returnValues", _obj(("destinationChain", _text(_pick(TRANSFER_DEST_CHAINS, ok))))),
                ("transaction", _obj(("from", _text(F.concat(F.lit("acct"), ck.cast("string")))))),
            ),
        ),
        ("amount", amount_json),
        ("value", value_json),
        ("symbol", _text(symbol)),
        ("gas", _obj(("gas_used_amount", gas_json))),
        ("gas_price_rate", _obj(("source_token", _obj(("token_price", _obj(("usd", token_usd_json))))))),
        ("fees", _obj(("express_fee_usd", express_json))),
        ("approved", _obj(("returnValues", _obj(("contractAddress", _text(_router_address(ok, 8))))))),
    )
    data = F.when(F.pmod(ok, F.lit(101)) == 0, F.lit("{bad")).otherwise(doc)
    status = F.when(F.col("o_orderstatus") == "P", F.lit("executing")).otherwise(F.lit("executed"))
    simplified = F.when(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"), F.lit("Received")
    ).otherwise(F.lit("received"))
    return orders.select(
        F.concat(
            F.lit("0x"), ok.cast("string"), F.lit("_"), (F.pmod(ck, F.lit(9)) + F.lit(1)).cast("string")
        ).alias("id"),
        F.col("o_orderdate").alias("created_at"),
        status.alias("status"),
        simplified.alias("simplified_status"),
        data.alias("data"),
    )


def bridge_events_from_orders(orders: DataFrame) -> DataFrame:
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        # A stored column, so the report's date range reaches the orders scan.
        F.col("o_orderdate").alias("block_timestamp"),
        F.concat(F.lit("0x"), ok.cast("string")).alias("tx_hash"),
        _pick(BRIDGE_SOURCE_CHAINS, ck).alias("source_chain"),
        _pick(BRIDGE_DEST_CHAINS, ok).alias("destination_chain"),
        F.when(F.pmod(ck, F.lit(29)) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("acct"), ck.cast("string")))
        .alias("sender"),
        F.concat(F.lit("tok"), F.substring(F.col("o_orderpriority"), 1, 1)).alias("token_symbol"),
    )


def split_small_scan(df: DataFrame, key: str) -> DataFrame:
    """``df``, dealt out by ``key`` to all cores if its scan has fewer splits than the cluster runs
    tasks at once.

    A table in one row group is read by one task, and everything built from its rows (JSON
    text, and its parsing) would stay in that task. Only the raw columns that are read are
    dealt out. A table of many row groups scans in many splits and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


class TestTableInputs:
    """The four dashboard inputs derived from ``{sf_dir}/{events,lineitem,orders}.parquet``.

    Each input is built on first use, so a report reads only the table it needs.
    Attribute names match :class:`ledgerlens.sources.Inputs`. With ``cluster`` the tables'
    rows are dealt out by their day before anything is derived from them, for storing.
    """

    #: Timestamp and key of the tables.
    RAW = {"events": ("ts", "event_id"), "lineitem": ("l_shipdate", "l_orderkey"), "orders": ("o_orderdate", "o_orderkey")}

    def __init__(self, spark: SparkSession, sf_dir: str, cluster: bool = False) -> None:
        self._spark = spark
        self._dir = sf_dir.rstrip("/")
        self._cluster = cluster

    def _table(self, name: str) -> DataFrame:
        table = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return clustered(table, *self.RAW[name]) if self._cluster else split_small_scan(table, self.RAW[name][1])

    @cached_property
    def ledger_tx(self) -> DataFrame:
        return normalize_flag(_require(ledger_tx_from_events(self._table("events")), "ledger_tx", LEDGER_TX_COLUMNS))

    @cached_property
    def token_transfers(self) -> DataFrame:
        return token_transfers_from_lineitem(self._table("lineitem"))

    @cached_property
    def orders(self) -> DataFrame:
        return self._table("orders")

    @cached_property
    def contract_calls(self) -> DataFrame:
        return contract_calls_from_orders(self.orders)

    @cached_property
    def bridge_events(self) -> DataFrame:
        return bridge_events_from_orders(self.orders)

    def between(self, start, end) -> TestTableInputs:
        """The inputs as they are: the test tables have no date column of their own."""
        return self

    def materialize(self) -> Inputs:
        """All four inputs as a plain :class:`Inputs`."""
        return from_frames(self.ledger_tx, self.token_transfers, self.contract_calls, self.bridge_events)


def load_inputs(spark: SparkSession, sf_dir: str) -> TestTableInputs:
    """The four dashboard inputs derived from the test tables under ``sf_dir`` (lazily)."""
    return TestTableInputs(spark, sf_dir)


def stage_inputs(
    spark: SparkSession, sf_dir: str, out_dir: str, data_type: str = "variant", by_day: bool = False
) -> Inputs:
    """Write the four derived inputs once as Parquet under ``out_dir`` and read them back.

    This is how the inputs exist in production: stored tables whose ``data`` payload
    is a VARIANT (``data_type="variant"``, parsed once here with ``try_parse_json``;
    malformed text becomes NULL, like a failed parse) or JSON text
    (``data_type="string"``). Spark writes VARIANT shredded, and reports then read
    only the shredded leaves they use. ``out_dir`` must be on storage shared by the
    cluster (for example below ``spark.checkpoint.dir``). Rows are clustered by day into
    files of bounded size, at least one for each core (:mod:`.layout`); ``by_day`` gives
    each day a folder of its own.
    """
    if data_type not in ("variant", "string"):
        raise ValueError(f"data_type must be 'variant' or 'string', not {data_type!r}")
    src = TestTableInputs(spark, sf_dir, cluster=True)
    out_dir = out_dir.rstrip("/")
    for name, timestamp in TIMES.items():
        write_table(as_variant(getattr(src, name), data_type), f"{out_dir}/{name}", timestamp, by_day)
    return stored_inputs(spark, out_dir, by_day)
