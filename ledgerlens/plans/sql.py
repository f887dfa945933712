"""The dashboard reports as Spark SQL text with named parameter markers.

For users who run reports as SQL. Each text names its inputs with ``{table}``
placeholders, filled by PySpark's SQL formatter either with the input DataFrames
themselves (``run_sql(..., inputs=...)``: no session state) or with the temp views
made by :func:`register_views`. ``:range_start``, ``:range_end`` (inclusive dates)
and ``:grain`` are bound with ``spark.sql(text, args=...)`` — no value is spliced
into the text, and the grain is still checked against the allow-list. Plans are the
same as the DataFrame reports' (same Catalyst input).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hash_part
from ..operators import finished, token_transfer_amounts, unified_transfers
from ..operators.routed import UNIFIED_COLUMNS
from ..params import as_date, check_grain
from .routed import columns_of

#: Column of a view that holds the partition's day.
VIEW_DAY = "__day"

VIEWS = ("ledger_tx", "routed_transfers", "token_transfer_values", "bridge_events")

_RANGE = "{col} >= CAST(:range_start AS TIMESTAMP_NTZ) AND {col} < CAST(date_add(:range_end, 1) AS TIMESTAMP_NTZ)"
_SUCCEEDED_LABEL = "CASE WHEN tx_succeeded THEN 'Succeeded' ELSE 'Failed' END"


def _date_bucket(date_expr: str) -> str:
    """First day of the :grain bucket of a DATE expression (date arithmetic only)."""
    return f"CASE WHEN :grain = 'day' THEN {date_expr} ELSE trunc({date_expr}, :grain) END"


def _time_bucket(col: str) -> str:
    return f"CAST({_date_bucket(f'to_date({col})')} AS TIMESTAMP_NTZ)"


def _bridge(rest: str, group: str = "") -> str:
    """The events of the range (``grouped``, with their bucket) and the hash totals, then ``rest``."""
    return f"""
WITH events AS (
    SELECT CAST(block_timestamp AS DATE) AS event_date, tx_hash, source_chain, destination_chain, sender
    FROM {{bridge_events}} WHERE {_RANGE.format(col="block_timestamp")}
), grouped AS (
    SELECT {_date_bucket("event_date") if group == "bucket" else "event_date"} AS bucket,
           tx_hash, source_chain, destination_chain, sender
    FROM events
), totals AS (
    SELECT tx_hash, sum(amount_usd) AS amount_usd
    FROM {{token_transfer_values}}
    WHERE finished AND {_RANGE.format(col="created_at")}
    GROUP BY tx_hash
), {rest}"""


def _hashes_users_volume(group: str) -> str:
    """One pass over the events, like the DataFrame reports."""
    keys, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    return _bridge(
        f"""each_value AS (
    SELECT {keys}stack(2, 0, tx_hash, 1, sender) AS (kind, value) FROM grouped
), per_value AS (
    SELECT {keys}kind, value, count(*) AS events FROM each_value GROUP BY {keys}kind, value
)
SELECT {keys}count_if(kind = 0 AND value IS NOT NULL) AS txn_count,
       count_if(kind = 1 AND value IS NOT NULL) AS user_count,
       round(sum(events * amount_usd)) AS volume_usd
FROM per_value LEFT JOIN totals ON value = tx_hash AND kind = 0 {by}""",
        group,
    )


def _ids_users_volume(group: str) -> str:
    """One pass over the transfers, like the DataFrame reports."""
    keys, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    return f"""
WITH transfers AS (
    SELECT {_time_bucket("created_at") if group else "created_at"} AS bucket, id, user_address, amount_usd
    FROM {{routed_transfers}}
    WHERE {_RANGE.format(col="created_at")}
), each_value AS (
    SELECT {keys}stack(2, 0, id, amount_usd, 1, user_address, CAST(NULL AS DOUBLE)) AS (kind, value, amount_usd) FROM transfers
), per_value AS (
    SELECT {keys}kind, value, sum(amount_usd) AS amount_usd FROM each_value GROUP BY {keys}kind, value
)
SELECT {keys}count_if(kind = 0 AND value IS NOT NULL) AS txn_count,
       count_if(kind = 1 AND value IS NOT NULL) AS user_count,
       round(sum(amount_usd)) AS volume_usd
FROM per_value {by}"""


REPORT_SQL = {
    "ledger_kpis": f"""
SELECT count(DISTINCT tx_id) AS txn_count,
       count(DISTINCT tx_from) AS user_count,
       round(try_divide(count(DISTINCT tx_id), count(DISTINCT tx_from))) AS txn_per_user
FROM {{ledger_tx}}
WHERE tx_succeeded AND {_RANGE.format(col="block_timestamp")}""",
    "ledger_status_over_time": f"""
SELECT {_time_bucket("block_timestamp")} AS bucket,
       count(DISTINCT tx_id) AS txn_count,
       {_SUCCEEDED_LABEL} AS status
FROM {{ledger_tx}}
WHERE {_RANGE.format(col="block_timestamp")}
GROUP BY 1, 3
ORDER BY 1 ASC NULLS LAST, 3""",
    "ledger_status_share_over_time": f"""
WITH counts AS (
    SELECT {_time_bucket("block_timestamp")} AS bucket,
           count(DISTINCT tx_id) AS txn_count,
           {_SUCCEEDED_LABEL} AS status
    FROM {{ledger_tx}}
    WHERE {_RANGE.format(col="block_timestamp")}
    GROUP BY 1, 3
)
SELECT bucket, txn_count, status,
       coalesce(try_divide(txn_count, sum(txn_count) OVER (PARTITION BY bucket)), 0D) AS share
FROM counts
ORDER BY 1 ASC NULLS LAST, 3""",
    "ledger_status_total_share": f"""
WITH totals AS (
    SELECT {_SUCCEEDED_LABEL} AS status, count(DISTINCT tx_id) AS txn_count
    FROM {{ledger_tx}}
    WHERE {_RANGE.format(col="block_timestamp")}
    GROUP BY 1
)
SELECT status, txn_count, coalesce(try_divide(txn_count, sum(txn_count) OVER ()), 0D) AS share
FROM totals
ORDER BY 1""",
    "ledger_users_over_time": f"""
SELECT {_time_bucket("block_timestamp")} AS bucket,
       count(DISTINCT tx_from) AS user_count,
       round(try_divide(count(DISTINCT tx_id), count(DISTINCT tx_from))) AS txn_per_user
FROM {{ledger_tx}}
WHERE tx_succeeded AND {_RANGE.format(col="block_timestamp")}
GROUP BY 1
ORDER BY 1 ASC NULLS LAST""",
    "ledger_status_totals": f"""
SELECT {_SUCCEEDED_LABEL} AS status, count(DISTINCT tx_id) AS txn_count
FROM {{ledger_tx}}
WHERE {_RANGE.format(col="block_timestamp")}
GROUP BY 1""",
    "routed_kpis": _ids_users_volume(""),
    "routed_over_time": _ids_users_volume("bucket") + " ORDER BY 1 ASC NULLS LAST",
    "routed_route_totals": f"""
SELECT source_chain, destination_chain,
       round(sum(amount_usd)) AS volume_usd,
       count(DISTINCT id) AS txn_count
FROM {{routed_transfers}}
WHERE {_RANGE.format(col="created_at")} AND amount_usd IS NOT NULL
GROUP BY 1, 2
ORDER BY 3 DESC, 4 ASC, 1 ASC NULLS LAST, 2 ASC NULLS LAST""",
    "bridge_kpis": _hashes_users_volume(""),
    "bridge_over_time": _hashes_users_volume("bucket") + " ORDER BY 1 ASC NULLS LAST",
    "bridge_route_totals": _bridge("""per_hash AS (
    SELECT source_chain, destination_chain, tx_hash, count(*) AS events FROM grouped GROUP BY ALL
)
SELECT source_chain, destination_chain, count(*) AS txn_count, round(sum(events * amount_usd)) AS volume_usd
FROM per_hash JOIN totals USING (tx_hash)
WHERE amount_usd IS NOT NULL
GROUP BY 1, 2
ORDER BY 3 DESC, 4 ASC, 1 ASC NULLS LAST, 2 ASC NULLS LAST"""),
}
GRAINED = {
    "ledger_status_over_time",
    "ledger_status_share_over_time",
    "ledger_users_over_time",
    "routed_over_time",
    "bridge_over_time",
}


def token_transfer_values(token_transfers: DataFrame) -> DataFrame:
    """Typed token-transfer leaves with the join hash and the finished flag (for SQL)."""
    parsed, v = token_transfer_amounts(token_transfers, ("amount", "amount_usd"))
    return parsed.select(
        "id",
        hash_part("id").alias("tx_hash"),
        "created_at",
        finished().alias("finished"),
        v["amount"].alias("amount"),
        v["amount_usd"].alias("amount_usd"),
    )


def _view_frames(inputs, columns=UNIFIED_COLUMNS) -> dict[str, Callable[[], DataFrame]]:
    return {
        "ledger_tx": lambda: inputs.ledger_tx,
        "routed_transfers": lambda: unified_transfers(inputs.token_transfers, inputs.contract_calls, columns=columns),
        "token_transfer_values": lambda: token_transfer_values(inputs.token_transfers),
        "bridge_events": lambda: inputs.bridge_events,
    }


def register_views(inputs) -> None:
    """Register :data:`VIEWS` as temp views of the given inputs (lazy, nothing runs).

    Views over inputs with date columns carry the day in a column of their own, on which
    :func:`run_sql` selects the range's partitions."""
    for view, build in _view_frames(inputs).items():
        build().createOrReplaceTempView(view)
    for name, column in getattr(inputs, "date_columns", {}).items():
        if name in VIEWS:
            inputs.dated[name].withColumnRenamed(column, VIEW_DAY).createOrReplaceTempView(name)


def _days(view: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """The view's rows on the range's days, where it carries the day."""
    if VIEW_DAY not in view.columns:
        return view
    return view.where(F.col(VIEW_DAY).between(F.lit(as_date(start)), F.lit(as_date(end)))).drop(VIEW_DAY)


def run_sql(
    spark: SparkSession,
    name: str,
    start: date | str,
    end: date | str,
    grain: str = "week",
    inputs=None,
) -> DataFrame:
    """Run report ``name`` from :data:`REPORT_SQL` with bound parameters, over ``inputs``
    when given, else over the views of :func:`register_views`.

    Inputs with date columns (tables partitioned by day) are restricted to the range's days
    on them as well, so that only these partitions are listed; views are, if
    ``register_views`` was given such inputs."""
    if name not in REPORT_SQL:
        raise KeyError(f"unknown report {name!r}; expected one of {sorted(REPORT_SQL)}")
    text = REPORT_SQL[name]
    args = {"range_start": F.lit(as_date(start)), "range_end": F.lit(as_date(end))}
    if name in GRAINED:
        args["grain"] = F.lit(check_grain(grain))
    if inputs is None:
        frames = {view: (lambda v=view: _days(spark.table(v), start, end)) for view in VIEWS}
    else:
        frames = _view_frames(inputs.between(start, end), columns_of(name))
    tables = {view: build() for view, build in frames.items() if "{" + view + "}" in text}
    return spark.sql(text, args=args, **tables)
