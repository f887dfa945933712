"""The driver contract: entry(), queries() and oracle_sql(), run on the smallest test tables.

Every registered query is compared with its DuckDB oracle at sf0.001 (the driver
does the same at sf0.01), and every physical plan is checked for the properties
the design relies on.
"""

from __future__ import annotations

import os

import duckdb
import pytest
from conftest import SF_SMALL

import __spark_entry__ as se
from tools.check_oracle import TABLES, _bag

NAMES = sorted(se._registry())  # the training-data operators have tests of their own


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.columns == ["bucket", "txn_count", "user_count", "volume_usd"]
    assert df.count() >= 0


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(se.queries()) and set(NAMES) <= set(se.oracle_sql())


def test_ranges_cover_every_row(spark):
    for table, column, (start, end) in [
        ("events", "ts", se.LEDGER_ALL),
        ("lineitem", "l_shipdate", se.CHAIN_ALL),
        ("orders", "o_orderdate", se.CHAIN_ALL),
    ]:
        days = spark.read.parquet(f"{SF_SMALL}/{table}.parquet").selectExpr(f"CAST({column} AS DATE) AS d")
        outside = days.where(f"d < DATE '{start}' OR d > DATE '{end}' OR d IS NULL")
        assert outside.isEmpty(), table


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = se.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(se.oracle_sql()[name])
    ocols = [x[0] for x in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _bag(rows, df.columns, None) == _bag(orows, ocols, None)


def _plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin", "RoundRobinPartitioning")


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_python_udf_or_pair_join(spark, capsys, name):
    plan = _plan(se.queries()[name](spark, SF_SMALL), capsys)
    for node in FORBIDDEN:
        assert node not in plan, node
    assert "ReadSchema" in plan


@pytest.mark.parametrize(
    "name,column",
    [
        ("ledger_kpis_mid", "ts"),
        ("routed_kpis_1998", "l_shipdate"),
        ("routed_kpis_1998", "o_orderdate"),
        ("bridge_kpis_1998", "l_shipdate"),
        ("bridge_kpis_1998", "o_orderdate"),
    ],
)
def test_date_range_reaches_the_scan(spark, capsys, name, column):
    plan = _plan(se.queries()[name](spark, SF_SMALL), capsys)
    pushed = [line for line in plan.splitlines() if line.startswith("PushedFilters")]
    assert any(f"GreaterThanOrEqual({column}," in p and f"LessThan({column}," in p for p in pushed), pushed


def test_scan_reads_only_needed_columns(spark, capsys):
    plan = _plan(se.queries()["ledger_kpis"](spark, SF_SMALL), capsys)
    schemas = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert schemas and all("value" not in s and "props" not in s for s in schemas), schemas
