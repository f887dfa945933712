"""Unified routed transfers: token transfers and contract calls in one schema.

Both services are kept only when they finished (``executed`` / ``received``) and
touch a router address; the union keeps duplicates. The date range is *not*
applied here: reports filter ``created_at`` above the union and Catalyst pushes
that filter into both branches and down to the Parquet scans.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contains_any_ci, safe_double, with_leaves
from ..params import (
    ROUTER_ADDRESSES,
    SERVICE_CONTRACT_CALLS,
    SERVICE_TOKEN_TRANSFERS,
    SIMPLIFIED_STATUS_RECEIVED,
    STATUS_EXECUTED,
)

UNIFIED_COLUMNS = (
    "created_at",
    "source_chain",
    "destination_chain",
    "user_address",
    "amount",
    "amount_usd",
    "fee",
    "id",
    "service",
    "raw_asset",
)

# JSON leaves read from token transfers.
TOKEN_TRANSFER_PATHS = {
    "source_chain": "send.original_source_chain",
    "destination_chain": "send.original_destination_chain",
    "amount": "send.amount",
    "fee_value": "send.fee_value",
    "price": "link.price",
    "asset": "link.asset",
}
# JSON leaves read from contract calls.
CONTRACT_CALL_PATHS = {
    "source_chain": "call.chain",
    "destination_chain": "call.returnValues.destinationChain",
    "user_address": "call.transaction.from",
    "amount": "amount",
    "value": "value",
    "gas_used": "gas.gas_used_amount",
    "token_price_usd": "gas_price_rate.source_token.token_price.usd",
    "express_fee_usd": "fees.express_fee_usd",
    "symbol": "symbol",
    "contract_address": "approved.returnValues.contractAddress",
}


def finished(status: str = "status", simplified_status: str = "simplified_status") -> Column:
    """Both status columns hold the finished values, compared with exact case."""
    return (F.col(status) == F.lit(STATUS_EXECUTED)) & (
        F.col(simplified_status) == F.lit(SIMPLIFIED_STATUS_RECEIVED)
    )


#: The leaves that each typed value needs.
TOKEN_TRANSFER_NEEDS = {
    "source_chain": ("source_chain",),
    "destination_chain": ("destination_chain",),
    "amount": ("amount",),
    "amount_usd": ("amount", "price"),
    "fee": ("fee_value",),
    "raw_asset": ("asset",),
}
CONTRACT_CALL_NEEDS = {
    "source_chain": ("source_chain",),
    "destination_chain": ("destination_chain",),
    "user_address": ("user_address",),
    "amount": ("amount",),
    "amount_usd": ("value",),
    "fee": ("gas_used", "token_price_usd", "express_fee_usd"),
    "raw_asset": ("symbol",),
}


def _leaves(
    df: DataFrame, paths: Mapping[str, str], needs: Mapping[str, Iterable[str]], columns: Iterable[str], always: Iterable[str] = ()
) -> tuple[DataFrame, dict[str, Column]]:
    """(frame, leaves): those of ``df.data`` that ``columns`` need, read by one parse of the text."""
    wanted = {leaf for c in columns for leaf in needs.get(c, ())} | set(always)
    return with_leaves(df, "data", {k: v for k, v in paths.items() if k in wanted}) if wanted else (df, {})


def token_transfer_amounts(
    token_transfers: DataFrame, columns: Iterable[str] = tuple(TOKEN_TRANSFER_NEEDS)
) -> tuple[DataFrame, dict[str, Column]]:
    """(frame, typed leaves of its token transfers): amount, amount_usd (amount x price), fee,
    lower-cased chains and the asset text; those of ``columns``. Select them from the frame."""
    columns = tuple(columns)
    parsed, leaf = _leaves(token_transfers, TOKEN_TRANSFER_PATHS, TOKEN_TRANSFER_NEEDS, columns)
    made = {
        "source_chain": lambda: F.lower(leaf["source_chain"]),
        "destination_chain": lambda: F.lower(leaf["destination_chain"]),
        "amount": lambda: safe_double(leaf["amount"]),
        "amount_usd": lambda: safe_double(leaf["amount"]) * safe_double(leaf["price"]),
        "fee": lambda: safe_double(leaf["fee_value"]),
        "raw_asset": lambda: leaf["asset"],
    }
    return parsed, {c: make() for c, make in made.items() if c in columns}


def contract_call_fee(gas_used: Column, token_price_usd: Column, express_fee_usd: Column) -> Column:
    """Gas used x source-token USD price when both are numbers, else the express fee."""
    return F.coalesce(safe_double(gas_used) * safe_double(token_price_usd), safe_double(express_fee_usd))


def token_transfer_rows(
    token_transfers: DataFrame,
    addresses: Iterable[str] = ROUTER_ADDRESSES,
    columns: Iterable[str] = UNIFIED_COLUMNS,
) -> DataFrame:
    """Token-transfer branch of the unified dataset."""
    columns = tuple(columns)
    kept, values = token_transfer_amounts(
        token_transfers.where(finished() & contains_any_ci("sender_address", addresses)), columns
    )
    made = values | {
        "created_at": F.col("created_at"),
        "user_address": F.col("recipient_address"),
        "id": F.col("id"),
        "service": F.lit(SERVICE_TOKEN_TRANSFERS),
    }
    return kept.select(*[made[c].alias(c) for c in columns])


def contract_call_rows(
    contract_calls: DataFrame,
    addresses: Iterable[str] = ROUTER_ADDRESSES,
    columns: Iterable[str] = UNIFIED_COLUMNS,
) -> DataFrame:
    """Contract-call branch of the unified dataset."""
    columns = tuple(columns)
    parsed, j = _leaves(
        contract_calls.where(finished()), CONTRACT_CALL_PATHS, CONTRACT_CALL_NEEDS, columns, always=("contract_address",)
    )
    kept = parsed.where(contains_any_ci(j["contract_address"], addresses))
    made = {
        "created_at": lambda: F.col("created_at"),
        "source_chain": lambda: F.lower(j["source_chain"]),
        "destination_chain": lambda: F.lower(j["destination_chain"]),
        "user_address": lambda: j["user_address"],
        "amount": lambda: safe_double(j["amount"]),
        "amount_usd": lambda: safe_double(j["value"]),
        "fee": lambda: contract_call_fee(j["gas_used"], j["token_price_usd"], j["express_fee_usd"]),
        "id": lambda: F.col("id"),
        "service": lambda: F.lit(SERVICE_CONTRACT_CALLS),
        "raw_asset": lambda: j["symbol"],
    }
    return kept.select(*[made[c]().alias(c) for c in columns])


def unified_transfers(
    token_transfers: DataFrame,
    contract_calls: DataFrame,
    addresses: Iterable[str] = ROUTER_ADDRESSES,
    columns: Iterable[str] = UNIFIED_COLUMNS,
) -> DataFrame:
    """``UNION ALL`` of both services with ``columns`` (of :data:`UNIFIED_COLUMNS`).

    ``user_address`` is the recipient for token transfers and the calling wallet for
    contract calls. Chains are lower-cased in both branches. A report names the columns it
    reads, so that no other JSON leaf is parsed.
    """
    addresses, columns = tuple(addresses), tuple(columns)
    return token_transfer_rows(token_transfers, addresses, columns).unionByName(
        contract_call_rows(contract_calls, addresses, columns)
    )
