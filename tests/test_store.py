"""The result store: a second refresh reads no input, ranges share days, changed inputs miss."""

from __future__ import annotations

import os
from datetime import date

import pytest
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens import REPORT_NAMES, Dashboard, ReportParams, load_inputs
from ledgerlens.operators.store import DAY, ResultStore, fingerprint, folders_in, uncovered
from ledgerlens.sources import stage_inputs

PARAMS = ReportParams("1995-01-01", "2024-12-31", "week")


def _files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("inputs"))
    return path, stage_inputs(spark, SF_SMALL, path)


def test_a_second_refresh_reads_no_input(spark, staged, tmp_path):
    _, inputs = staged
    expected = {n: df.collect() for n, df in Dashboard(inputs, PARAMS).reports().items()}
    store = str(tmp_path / "store")
    first = Dashboard(inputs, PARAMS, reuse="store", shared_path=store)
    assert first.run_all() == expected
    first.release()
    before = _files(store)
    again = Dashboard(inputs, PARAMS, reuse="store", shared_path=store)
    read = {f for n in REPORT_NAMES for f in again.report(n).inputFiles()}
    assert read and all(f.startswith(f"file://{store}/") for f in read)
    assert again.run_all() == expected
    assert _files(store) == before  # nothing was made anew
    assert again.evict() == 0
    other = Dashboard(inputs, ReportParams("1996-01-01", "1997-12-31", "month"), reuse="store", shared_path=store)
    assert other.report("routed_kpis").collect() == Dashboard(inputs, other.params).report("routed_kpis").collect()
    segments = [f for f in before if "/unified/" in f]
    assert [f for f in _files(store) if "/unified/" in f] == segments  # its days were there
    assert other.evict() > 0 and not os.path.exists(f"{store}/bridge_kpis") or folders_in(spark, f"{store}/bridge_kpis") == []


def test_overlapping_ranges_share_days(spark, staged, tmp_path):
    _, inputs = staged
    store = str(tmp_path / "store")
    asked = []

    class Watched(Dashboard):
        def _unified_rows(self, start, end):
            asked.append((str(start), str(end)))
            return super()._unified_rows(start, end)

    ranges = [("1996-01-01", "1996-06-30"), ("1996-04-01", "1996-12-31"), ("1995-06-01", "1997-06-30"), ("1996-02-01", "1996-03-01")]
    for start, end in ranges:
        p = ReportParams(start, end, "month")
        got = Watched(inputs, p, reuse="store", shared_path=store).report("routed_over_time").collect()
        assert got == Dashboard(inputs, p).report("routed_over_time").collect()
    assert asked == [("1996-01-01", "1996-06-30"), ("1996-07-01", "1996-12-31"), ("1995-06-01", "1995-12-31"), ("1997-01-01", "1997-06-30")]


def test_changed_files_are_another_entry(spark, tmp_path):
    at = str(tmp_path / "in")
    spark.range(3).selectExpr("timestamp_ntz'2025-01-01' AS t", "id").write.parquet(at)
    store, built = ResultStore(spark, str(tmp_path / "store")), []

    def rows(n):
        def build():
            built.append(n)
            return spark.range(n)

        return build

    one = spark.read.parquet(at)
    assert store.result("r", {"p": "1"}, [one], rows(1)).count() == 1
    assert store.result("r", {"p": "1"}, [one], rows(2)).count() == 1
    assert store.result("r", {"p": "2"}, [one], rows(3)).count() == 3
    spark.range(1).selectExpr("timestamp_ntz'2025-01-02' AS t", "id").write.mode("append").parquet(at)
    two = spark.read.parquet(at)
    assert fingerprint([one]) != fingerprint([two])
    assert store.result("r", {"p": "1"}, [two], rows(4)).count() == 4
    assert built == [1, 3, 4]
    assert store.evict("r", [({"p": "1"}, [two])]) == 2
    assert store.result("r", {"p": "1"}, [two], rows(5)).count() == 4
    store.clear()
    assert not os.path.exists(store.path)
    with pytest.raises(ValueError):
        fingerprint([spark.range(3)])


def test_unfinished_writes_and_doubled_segments_do_no_harm(spark, tmp_path):
    at = str(tmp_path / "in")
    spark.sql("SELECT CAST(d AS TIMESTAMP_NTZ) AS t FROM (SELECT explode(sequence(DATE'2025-01-01', DATE'2025-01-20')) AS d)").write.parquet(at)
    source = spark.read.parquet(at)
    store = ResultStore(spark, str(tmp_path / "store"))

    def build(a, b):
        return source.where(f"t >= '{a}' AND t < date_add(DATE'{b}', 1)")

    def days(a, b):
        return sorted(r["t"].day for r in store.rows("x", [source], "t", a, b, build).collect())

    assert days("2025-01-03", "2025-01-10") == list(range(3, 11))
    folder = store._folder("x", {}, [source])
    build(date(2025, 1, 8), date(2025, 1, 15)).write.parquet(f"{folder}/2025-01-08_2025-01-15_another")  # another writer's
    os.makedirs(f"{folder}/2025-01-01_2025-01-20_lost")  # a lost job's
    assert days("2025-01-01", "2025-01-20") == list(range(1, 21))
    assert days("2025-01-09", "2025-01-09") == [9]
    assert store.evict("x", [({}, [source])]) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)).map(sorted), max_size=6), st.integers(0, 30), st.integers(0, 10))
def test_gaps_are_the_days_without_a_segment(segments, start, length):
    zero = date(2025, 1, 1)
    spans = [(zero + a * DAY, zero + b * DAY) for a, b in segments]
    gaps = uncovered(zero + start * DAY, zero + (start + length) * DAY, spans)
    held = {x for a, b in segments for x in range(a, b + 1)}
    assert [x for a, b in gaps for x in range((a - zero).days, (b - zero).days + 1)] == [
        x for x in range(start, start + length + 1) if x not in held
    ]


def test_parquet_reuse_leaves_no_file(spark, tmp_path):
    dash = Dashboard(load_inputs(spark, SF_SMALL), PARAMS, reuse="parquet", shared_path=str(tmp_path / "shared"))
    dash.run_all(names=("routed_kpis", "bridge_kpis"))
    assert _files(tmp_path / "shared")
    dash.release()
    assert _files(tmp_path / "shared") == []


def test_store_needs_a_path(spark):
    with pytest.raises(ValueError):
        Dashboard(load_inputs(spark, SF_SMALL), PARAMS, reuse="store")
