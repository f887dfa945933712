"""Column helpers on hand-made rows (expected values written by hand)."""

from __future__ import annotations

import pytest
from conftest import d, ts
from pyspark.sql import functions as F

from ledgerlens.functions import (
    contains_any_ci,
    date_bucket,
    hash_part,
    in_date_range,
    json_leaves,
    leaf_schema,
    rounded_ratio,
    safe_double,
    share_within,
    status_label,
    time_bucket,
)
from ledgerlens.params import ROUTER_ADDRESSES, ReportParams, check_grain


def test_safe_double_text_forms(spark):
    cases = {
        "12.5": 12.5,
        "1e3": 1000.0,
        " 12 ": 12.0,
        "+5": 5.0,
        ".5": 0.5,
        "5.": 5.0,
        "[1]": None,
        '{"a":1}': None,
        "true": None,
        "n/a": None,
        "": None,
        "1,000": None,
        "1d": None,
        "1.0f": None,
        "2.5D ": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.v for r in df.select("t", safe_double("t").alias("v")).collect()}
    for k, v in cases.items():
        assert got[k] == v, k
    assert got[None] is None


KIND_DOCS = [
    ('{"send":{"amount":"12.5"}}', 12.5),
    ('{"send":{"amount":12.5}}', 12.5),
    ('{"send":{"amount":"1e3"}}', 1000.0),
    ('{"send":{"amount":[1]}}', None),
    ('{"send":{"amount":{"a":1}}}', None),
    ('{"send":{"amount":true}}', None),
    ('{"send":{"amount":"n/a"}}', None),
    ('{"send":{"amount":""}}', None),
    ('{"send":{"amount":null}}', None),
    ('{"send":{}}', None),
    ('{"send":{"amount":"1d"}}', None),
    ("{bad", None),
    (None, None),
]


@pytest.mark.parametrize("as_variant", [False, True])
def test_json_leaves_every_kind(spark, as_variant):
    df = spark.createDataFrame([(i, doc) for i, (doc, _) in enumerate(KIND_DOCS)], "i int, data string")
    if as_variant:
        df = df.select("i", F.try_parse_json("data").alias("data"))
    leaf = json_leaves(df, "data", {"amount": "send.amount"})
    got = dict(df.select("i", safe_double(leaf["amount"]).alias("v")).collect())
    for i, (_, want) in enumerate(KIND_DOCS):
        assert got[i] == want, KIND_DOCS[i]


def test_json_leaves_variant_matches_text(spark):
    df = spark.createDataFrame(
        [('{"a":{"b":"7"}}',), ('{"a":{"b":[1]}}',), ('{"a":{"b":true}}',), ('{"a":{"B":3}}',)], "data string"
    )
    text = json_leaves(df, "data", {"x": "a.b"})
    as_text = [r.v for r in df.select(safe_double(text["x"]).alias("v")).collect()]
    vdf = df.select(F.try_parse_json("data").alias("data"))
    var = json_leaves(vdf, "data", {"x": "a.b"})
    as_variant = [r.v for r in vdf.select(safe_double(var["x"]).alias("v")).collect()]
    assert as_text == as_variant == [7.0, None, None, None]  # keys are case-sensitive


def test_leaf_schema_merges_and_rejects_conflicts():
    s = leaf_schema({"a": "call.chain", "b": "call.returnValues.destinationChain", "c": "value"})
    assert [f.name for f in s.fields] == ["call", "value"]
    assert [f.name for f in s["call"].dataType.fields] == ["chain", "returnValues"]
    with pytest.raises(ValueError):
        leaf_schema({"a": "x.y", "b": "x.y.z"})
    with pytest.raises(ValueError):
        leaf_schema({"a": "x.y.z", "b": "x.y"})


def test_in_date_range_inclusive_ends(spark):
    rows = [
        ("2025-01-01 00:00:00", True),
        ("2025-01-31 23:59:59.999999", True),
        ("2025-02-01 00:00:00", False),
        ("2024-12-31 23:59:59.999999", False),
    ]
    df = spark.createDataFrame([(ts(a), want) for a, want in rows], "t timestamp_ntz, want boolean")
    got = df.select(in_date_range("t", d("2025-01-01"), "2025-01-31").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    # A reversed range matches nothing.
    assert df.where(in_date_range("t", "2025-02-01", "2025-01-01")).count() == 0


def test_time_bucket_week_starts_monday(spark):
    df = spark.createDataFrame(
        [(ts("2025-01-05 23:00:00"),), (ts("2025-01-06 00:00:00"),), (ts("2025-01-31 12:00:00"),)],
        "t timestamp_ntz",
    )
    week = [r.b for r in df.select(time_bucket("t", "week").alias("b")).collect()]
    assert week == [ts("2024-12-30 00:00:00"), ts("2025-01-06 00:00:00"), ts("2025-01-27 00:00:00")]
    month = [r.b for r in df.select(time_bucket("t", "month").alias("b")).collect()]
    assert month == [ts("2025-01-01 00:00:00")] * 3
    day = [r.b for r in df.select(time_bucket("t", "day").alias("b")).collect()]
    assert day == [ts("2025-01-05 00:00:00"), ts("2025-01-06 00:00:00"), ts("2025-01-31 00:00:00")]
    assert dict(df.select(time_bucket("t", "week").alias("b")).dtypes)["b"] == "timestamp_ntz"


def test_date_bucket_day_grain_is_not_null(spark):
    df = spark.createDataFrame([(d("2025-01-05"),), (d("2025-03-31"),)], "x date")
    for grain, want in {
        "day": [d("2025-01-05"), d("2025-03-31")],
        "week": [d("2024-12-30"), d("2025-03-31")],
        "month": [d("2025-01-01"), d("2025-03-01")],
    }.items():
        assert [r.b for r in df.select(date_bucket("x", grain).alias("b")).collect()] == want


def test_unknown_grain_rejected():
    with pytest.raises(ValueError):
        check_grain("hour")
    with pytest.raises(ValueError):
        ReportParams(grain="year")
    with pytest.raises(ValueError):
        time_bucket("t", "quarter'); drop table x; --")


def test_contains_any_ci(spark):
    a = ROUTER_ADDRESSES
    df = spark.createDataFrame(
        [(a[0].upper(),), ("prefix-" + a[3].lower() + "-suffix",), (None,), ("0xabc",), (a[2][:-1],)], "s string"
    )
    got = [r.m for r in df.select(contains_any_ci("s", a).alias("m")).collect()]
    assert got == [True, True, None, False, False]


def test_status_label_null_is_failed(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert [r.s for r in df.select(status_label("f").alias("s")).collect()] == ["Succeeded", "Failed", "Failed"]


def test_rounded_ratio(spark):
    df = spark.createDataFrame([(5, 2), (7, 2), (1, 3), (4, 0)], "a long, b long")
    got = [r.r for r in df.select(rounded_ratio("a", "b").alias("r")).collect()]
    assert got == [3.0, 4.0, 0.0, None]


def test_share_within(spark):
    df = spark.createDataFrame([("x", 3), ("x", 1), ("y", 0), ("y", 0)], "k string, n long")
    got = sorted((r.k, r.n, r.s) for r in df.select("k", "n", share_within("n", "k").alias("s")).collect())
    assert got == [("x", 1, 0.25), ("x", 3, 0.75), ("y", 0, 0.0), ("y", 0, 0.0)]


def test_hash_part(spark):
    df = spark.createDataFrame([("0xab_1",), ("0xab",), ("0xab_1_2",), ("_x",), ("",), (None,)], "id string")
    assert [r.h for r in df.select(hash_part("id").alias("h")).collect()] == ["0xab", "0xab", "0xab", "", "", None]


def test_range_and_buckets_do_not_depend_on_time_zones(spark, monkeypatch):
    import time as _time

    monkeypatch.setenv("TZ", "Asia/Tokyo")
    _time.tzset()
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.createDataFrame(
            [("2025-01-01 00:00:00",), ("2024-12-31 23:59:59",), ("2025-01-31 23:59:59",), ("2025-02-01 00:00:00",)], "s string"
        ).select(F.col("s").cast("timestamp_ntz").alias("t"))
        got = [(r.k, r.b) for r in df.select(in_date_range("t", "2025-01-01", "2025-01-31").alias("k"), time_bucket("t", "week").alias("b")).collect()]
        assert got == [
            (True, ts("2024-12-30 00:00:00")),
            (False, ts("2024-12-30 00:00:00")),
            (True, ts("2025-01-27 00:00:00")),
            (False, ts("2025-01-27 00:00:00")),
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
        monkeypatch.delenv("TZ")
        _time.tzset()
