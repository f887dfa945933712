"""


The ledger queries derive the four dashboard inputs from the whole test tables
(``events``, ``lineitem``, ``orders``) with :func:`ledgerlens.load_inputs` and runs
one report or operator on them. Date ranges are the reports' own parameter:
the main keys use a range that covers all rows of the tables; the ``_mid`` and
``_1998`` keys use an inner range to check the inclusive range ends and the
independent range filter on each side of the bridge join (the scans still read
the whole tables). The ``sql_*`` keys run the same twelve reports as SQL text with
bound parameters and share their DataFrame twins' oracle, as do the ``rollup_*`` keys, which
count from daily tables of bitmaps.

The ``op*`` keys and ``pipeline`` apply the training-data operators of ``ledgerlens.llm``
to the whole ``documents`` table; they are there only where that subpackage is.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The package and the oracle live next to this file; make them importable however
# this module is loaded (by name or by file path).
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

import oracle_queries as oq  # noqa: E402
from ledgerlens import load_inputs  # noqa: E402
from ledgerlens.functions import contains_any_ci, safe_double, with_leaves  # noqa: E402
from ledgerlens.operators import contract_call_fee as fee_expr  # noqa: E402
from ledgerlens.operators import bridge_sides, priced_bridge_rows, token_transfer_amounts, unified_transfers  # noqa: E402
from ledgerlens.operators import priced_bridge_events as priced_events  # noqa: E402
from ledgerlens.operators.routed import CONTRACT_CALL_PATHS  # noqa: E402
from ledgerlens.params import ROUTER_ADDRESSES, SERVICE_CONTRACT_CALLS, SERVICE_TOKEN_TRANSFERS  # noqa: E402
from ledgerlens.plans import bridge, ledger, routed  # noqa: E402
from ledgerlens.plans.rollup import build_rollups  # noqa: E402
from ledgerlens.plans.sql import REPORT_SQL, run_sql  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"

# Ranges covering every row of the test tables (events: January 2024; lineitem and
# orders: 1995-01-01 .. 2001-11-04), and inner ranges that cut through the data.
LEDGER_ALL = ("2024-01-01", "2024-01-31")
LEDGER_MID = ("2024-01-08", "2024-01-21")
CHAIN_ALL = ("1995-01-01", "2001-12-31")
CHAIN_1998 = ("1998-01-01", "1998-12-31")


# --- query callables ----------------------------------------------------------------------


def _ledger(report, rng, *extra):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(load_inputs(spark, sf_dir).ledger_tx, *rng, *extra)

    return run


def _routed(report, rng, *extra):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inp = load_inputs(spark, sf_dir)
        columns = routed.columns_of(report.__name__)
        return report(unified_transfers(inp.token_transfers, inp.contract_calls, columns=columns), *rng, *extra)

    return run


def _bridge(report, rng, *extra, prune=False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inp = load_inputs(spark, sf_dir)
        return report(bridge_sides(inp.bridge_events, inp.token_transfers, *rng, prune=prune), *extra)

    return run


def unified_transfers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = load_inputs(spark, sf_dir)
    return unified_transfers(inp.token_transfers, inp.contract_calls)


def _priced_bridge_events(rng, prune=False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inp = load_inputs(spark, sf_dir)
        return priced_events(inp.bridge_events, inp.token_transfers, *rng, prune=prune)

    return run


def _priced_bridge_rows(rng, prune=False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inp = load_inputs(spark, sf_dir)
        return priced_bridge_rows(inp.bridge_events, inp.token_transfers, *rng, prune=prune)

    return run


def safe_double_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed leaves of every token transfer (all JSON kinds, malformed documents)."""
    tt = load_inputs(spark, sf_dir).token_transfers
    parsed, v = token_transfer_amounts(tt)
    return parsed.select(
        "id",
        v["source_chain"].alias("source_chain"),
        v["destination_chain"].alias("destination_chain"),
        v["amount"].alias("amount"),
        v["amount_usd"].alias("amount_usd"),
        v["fee"].alias("fee"),
        v["raw_asset"].alias("raw_asset"),
    )


def contract_call_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount, USD value and fee (gas x token price, else express fee) of every contract call."""
    cc = load_inputs(spark, sf_dir).contract_calls
    parsed, j = with_leaves(cc, "data", CONTRACT_CALL_PATHS)
    return parsed.select(
        "id",
        safe_double(j["amount"]).alias("amount"),
        safe_double(j["value"]).alias("amount_usd"),
        fee_expr(j["gas_used"], j["token_price_usd"], j["express_fee_usd"]).alias("fee"),
    )


def address_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per service and router-address test outcome (true / false / NULL address)."""
    inp = load_inputs(spark, sf_dir)
    tt = inp.token_transfers.select(
        F.lit(SERVICE_TOKEN_TRANSFERS).alias("service"),
        contains_any_ci("sender_address", ROUTER_ADDRESSES).alias("matched"),
    )
    parsed, j = with_leaves(inp.contract_calls, "data", {"a": "approved.returnValues.contractAddress"})
    cc = parsed.select(
        F.lit(SERVICE_CONTRACT_CALLS).alias("service"),
        contains_any_ci(j["a"], ROUTER_ADDRESSES).alias("matched"),
    )
    return tt.unionByName(cc).groupBy("service", "matched").agg(F.count(F.lit(1)).alias("row_count"))


def _sql(name, rng, grain="week"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, name, *rng, grain, inputs=load_inputs(spark, sf_dir))

    return run


def _rollup(name, rng, *extra):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(build_rollups(load_inputs(spark, sf_dir)), name)(*rng, *extra)

    return run


ROLLUPS = (
    ("ledger_kpis", LEDGER_ALL),
    ("ledger_kpis", LEDGER_MID),
    ("ledger_status_totals", LEDGER_ALL),
    ("ledger_status_over_time", LEDGER_ALL),
    ("ledger_users_over_time", LEDGER_ALL),
    ("routed_kpis", CHAIN_ALL),
    ("routed_kpis", CHAIN_1998),
    ("routed_over_time", CHAIN_ALL),
    ("routed_route_totals", CHAIN_ALL),
    ("routed_route_totals", CHAIN_1998),
)

_GRAIN_SUFFIX = {"week": "", "day": "_day", "month": "_month"}


def _registry() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    reg: dict[str, tuple[Callable, str]] = {
        "ledger_kpis": (_ledger(ledger.ledger_kpis, LEDGER_ALL), oq.ledger_kpis(*LEDGER_ALL)),
        "ledger_kpis_mid": (_ledger(ledger.ledger_kpis, LEDGER_MID), oq.ledger_kpis(*LEDGER_MID)),
        "ledger_status_totals": (
            _ledger(ledger.ledger_status_totals, LEDGER_ALL),
            oq.ledger_status_totals(*LEDGER_ALL),
        ),
        "ledger_status_total_share": (
            _ledger(ledger.ledger_status_total_share, LEDGER_ALL),
            oq.ledger_status_total_share(*LEDGER_ALL),
        ),
        "ledger_status_share_over_time": (
            _ledger(ledger.ledger_status_share_over_time, LEDGER_ALL, "week"),
            oq.ledger_status_share_over_time(*LEDGER_ALL, "week"),
        ),
        "status_share": (
            _ledger(ledger.ledger_status_share_over_time, LEDGER_ALL, "day"),
            oq.ledger_status_share_over_time(*LEDGER_ALL, "day"),
        ),
        "routed_kpis": (_routed(routed.routed_kpis, CHAIN_ALL), oq.routed_kpis(*CHAIN_ALL)),
        "routed_kpis_1998": (_routed(routed.routed_kpis, CHAIN_1998), oq.routed_kpis(*CHAIN_1998)),
        "routed_route_totals": (
            _routed(routed.routed_route_totals, CHAIN_ALL),
            oq.routed_route_totals(*CHAIN_ALL),
        ),
        "routed_route_totals_1998": (
            _routed(routed.routed_route_totals, CHAIN_1998),
            oq.routed_route_totals(*CHAIN_1998),
        ),
        "bridge_kpis": (_bridge(bridge.bridge_kpis, CHAIN_ALL), oq.bridge_kpis(*CHAIN_ALL)),
        "bridge_kpis_1998": (_bridge(bridge.bridge_kpis, CHAIN_1998), oq.bridge_kpis(*CHAIN_1998)),
        "bridge_route_totals": (
            _bridge(bridge.bridge_route_totals, CHAIN_ALL),
            oq.bridge_route_totals(*CHAIN_ALL),
        ),
        "bridge_route_totals_1998": (
            _bridge(bridge.bridge_route_totals, CHAIN_1998),
            oq.bridge_route_totals(*CHAIN_1998),
        ),
        "unified_transfers": (unified_transfers_query, oq.unified_transfers()),
        "priced_bridge_events": (_priced_bridge_events(CHAIN_ALL), oq.priced_bridge_events(*CHAIN_ALL)),
        "priced_bridge_events_1998": (_priced_bridge_events(CHAIN_1998), oq.priced_bridge_events(*CHAIN_1998)),
        "priced_bridge_rows": (_priced_bridge_rows(CHAIN_ALL), oq.priced_bridge_rows(*CHAIN_ALL)),
        "priced_bridge_rows_1998": (_priced_bridge_rows(CHAIN_1998), oq.priced_bridge_rows(*CHAIN_1998)),
        # Transfers pruned by the events' hashes before their payload is read.
        "bridge_kpis_pruned_1998": (_bridge(bridge.bridge_kpis, CHAIN_1998, prune=True), oq.bridge_kpis(*CHAIN_1998)),
        "priced_bridge_events_pruned_1998": (
            _priced_bridge_events(CHAIN_1998, prune=True),
            oq.priced_bridge_events(*CHAIN_1998),
        ),
        "priced_bridge_rows_pruned_1998": (_priced_bridge_rows(CHAIN_1998, prune=True), oq.priced_bridge_rows(*CHAIN_1998)),
        "safe_double_extract": (safe_double_extract, oq.safe_double_extract()),
        "contract_call_fee": (contract_call_fee, oq.contract_call_fee()),
        "address_match": (address_match, oq.address_match()),
    }
    for grain, suffix in _GRAIN_SUFFIX.items():
        reg["ledger_status_over_time" + suffix] = (
            _ledger(ledger.ledger_status_over_time, LEDGER_ALL, grain),
            oq.ledger_status_over_time(*LEDGER_ALL, grain),
        )
        reg["ledger_users_over_time" + suffix] = (
            _ledger(ledger.ledger_users_over_time, LEDGER_ALL, grain),
            oq.ledger_users_over_time(*LEDGER_ALL, grain),
        )
        reg["routed_over_time" + suffix] = (
            _routed(routed.routed_over_time, CHAIN_ALL, grain),
            oq.routed_over_time(*CHAIN_ALL, grain),
        )
        reg["bridge_over_time" + suffix] = (
            _bridge(bridge.bridge_over_time, CHAIN_ALL, grain),
            oq.bridge_over_time(*CHAIN_ALL, grain),
        )
    # Reports from daily tables of distinct sets, checked against the row-level oracle.
    for name, rng in ROLLUPS:
        grains = _GRAIN_SUFFIX if name.endswith("_over_time") else {"": ""}
        for grain, suffix in grains.items():
            suffix = suffix or {LEDGER_MID: "_mid", CHAIN_1998: "_1998"}.get(rng, "")
            reg["rollup_" + name + suffix] = (_rollup(name, rng, *([grain] if grain else [])), reg[name + suffix][1])
    # The same twelve reports run as SQL text with bound parameters (plans.sql),
    # checked against the same oracle as their DataFrame twins.
    for name in REPORT_SQL:
        rng = LEDGER_ALL if name.startswith("ledger") else CHAIN_ALL
        reg["sql_" + name] = (_sql(name, rng), reg[name][1])
    return reg


def _llm() -> tuple[dict[str, Callable], dict[str, str]]:
    """Queries and SQL of the training-data operators and the pipeline over them, or
    none where those folders are not installed (the only place that allows for it)."""
    try:
        import corpus_pipeline
        from ledgerlens.llm.queries import QUERIES, SQL
    except ModuleNotFoundError as e:
        if e.name not in ("corpus_pipeline", "ledgerlens.llm", "ledgerlens.llm.queries"):
            raise
        return {}, {}
    found, texts = dict(QUERIES), dict(SQL)
    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        texts["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, texts


def entry(spark: SparkSession) -> DataFrame:
    return queries()["routed_over_time"](spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per implemented report / operator; each takes (spark, sf_dir)."""
    return {name: fn for name, (fn, _) in _registry().items()} | _llm()[0]


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL over the pre-registered test-table views, for each ``queries()`` key that
    SQL can express (of the training-data operators, some cannot be)."""
    return {name: sql for name, (_, sql) in _registry().items()} | _llm()[1]
