"""Operators of DataFrame functions alone: against DuckDB, by hand, and on odd rows."""

from __future__ import annotations

import hashlib
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import cases  # noqa: E402

from ledgerlens.llm import common, mixing, multiset_hash, queries  # noqa: E402
from ledgerlens.llm.exact_dedup import exact_dedup  # noqa: E402
from ledgerlens.llm.jump_shards import assign_shards, jump_hash, write_shards  # noqa: E402
from ledgerlens.llm.mixing import mix_sources, mixed_documents, source_targets  # noqa: E402
from tools.check_oracle import _bag  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_SMALL}/{table}.parquet')")
    df = queries.QUERIES[name](spark, SF_SMALL)
    cur = con.execute(queries.SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert _bag([tuple(r) for r in df.collect()], df.columns, 9) == _bag(cur.fetchall(), columns, 9)


NATIVE = ("op4_jump_shards", "op5_exact_dedup", "op7_multiset_fingerprints", "op10_mix_sources", "op13_merkle_manifest")


@pytest.mark.parametrize("name", NATIVE)
def test_main_path_has_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow|CartesianProduct|NestedLoop", plan)


# --- sharding ---------------------------------------------------------------------------


def _jump(key: int, shards: int) -> int:
    key &= 2**64 - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, 2, 255, 256, 10**9 + 7, -1, -(2**63), 2**63 - 1, 0xDEADBEEF]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 100):
        got = {r.k: r.s for r in df.select("k", jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {k: _jump(k, n) for k in keys}
    assert df.select(jump_hash(F.lit(None).cast("long"), 8)).first()[0] == _jump(0, 8)
    with pytest.raises(ValueError):
        jump_hash(F.col("k"), 0)


def test_shards_on_odd_rows(spark, tmp_path):
    df = cases.frame(spark)
    rows = assign_shards(df, 3, bucket_rows=2).collect()
    assert len(rows) == len(cases.TEXTS)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 3)
        assert r.shard == _jump(r.doc_id or 0, 3)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in rows}
    for i, text, *_ in cases.TEXTS:
        data = (text or "").encode()
        assert sizes[i] == (len(data) + 1, zlib.crc32(data))
    assert assign_shards(cases.empty(spark), 3).count() == 0
    write_shards(df.drop("shard"), str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == len(by_shard)


def test_running_sum_over_buckets(spark):
    df = spark.range(1000).selectExpr("id", "CAST(NULL AS STRING) AS g", "id DIV 7 AS bucket", "id % 5 AS v")
    got = {r.id: r.s for r in common.running_sum(df, "g", "bucket", [F.col("id")], "v", "s").collect()}
    want, total = {}, 0
    for i in range(1000):
        want[i] = total
        total += i % 5
    assert got == want


# --- exact deduplication -----------------------------------------------------------------


def _dedup_by_hand(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        content = re.sub("[\x20\x09-\x0d]", "", text or "")
        groups[content].append((len(text or ""), i))
    out = Counter()
    for content, members in groups.items():
        best = min(members, key=lambda m: (-m[0], m[1] is None, m[1] or 0))[1]
        for _, i in members:
            out[i, best, len(members), i == best, hashlib.sha256(content.encode()).hexdigest()] += 1
    return out


def test_dedup_on_odd_rows(spark):
    df = cases.frame(spark)
    got = Counter(tuple(r) for r in exact_dedup(df, salts=3).collect())
    assert got == _dedup_by_hand(cases.TEXTS)
    assert exact_dedup(cases.empty(spark)).count() == 0


def test_equal_digests_of_different_texts_stay_apart(spark):
    weak = lambda content: F.pmod(F.crc32(F.encode(content, "UTF-8")), F.lit(3)).cast("string")
    got = Counter(tuple(r)[:4] for r in exact_dedup(cases.frame(spark), salts=2, digest=weak).collect())
    want = Counter()
    for k, n in _dedup_by_hand(cases.TEXTS).items():
        want[k[:4]] += n
    assert got == want


def test_a_hot_group_of_copies(spark):
    df = spark.range(3000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN concat('same text', repeat(' ', CAST(id % 5 AS INT))) ELSE concat('t', id) END AS text"
    )
    rows = exact_dedup(df).where("group_size > 1").collect()
    assert len(rows) == 1000 and {(r.keep_id, r.group_size) for r in rows} == {(9, 1000)}
    assert [r.doc_id for r in rows if r.kept] == [9]


# --- fingerprints ------------------------------------------------------------------------


def _sums(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return multiset_hash.with_sums(df, "text", "h")


def test_order_does_not_matter_and_pieces_come_and_go(spark):
    rows = _sums(spark, "One. Two.\nThree.\n", "Three.\n Two.\nOne.", "One.", " Two.\nThree.\n", None, "").collect()
    a, b, one, rest, null, empty = rows
    assert (a.h_n, b.h_n) == (3, 3) and a.h_sums == b.h_sums
    assert (null.h_n, empty.h_n) == (0, 0) and set(null.h_sums) == {0}
    df = spark.createDataFrame([(a.h_n, a.h_sums, one.h_n, one.h_sums)], "n long, s array<long>, pn long, ps array<long>")
    for insert, want_n in ((False, 2), (True, 4)):
        n, s = multiset_hash.combine(F.col("n"), F.col("s"), F.col("pn"), F.col("ps"), insert)
        got = df.select(n.alias("n"), s.alias("s")).first()
        assert got.n == want_n
        if not insert:
            assert got.s == rest.h_sums


def test_pieces_give_back_the_text(spark):
    df = cases.frame(spark).select("text", F.array_join(multiset_hash.pieces(F.col("text")), "").alias("again"))
    assert all((r.text or "") == r.again for r in df.collect())


def test_masked_sums_equal_plain_ones_modulo_the_lane(spark):
    many = "a.b!" * 17_000  # 34,000 pieces: beyond one lane
    few = _sums(spark, "a.", "b!").collect()
    got = _sums(spark, many).first()
    assert got.h_n == 34_000
    lane = multiset_hash.LANE_MODULUS - 1
    for k, x in enumerate(got.h_sums):
        for i in range(multiset_hash.LANES_A_LONG):
            shift = multiset_hash.LANE_BITS * i
            want = sum(17_000 * (f.h_sums[k] >> shift & lane) for f in few)
            assert x >> shift & lane == want & lane


def test_fingerprints_on_odd_rows(spark):
    rows = multiset_hash.fingerprint_with_edits(cases.frame(spark)).collect()
    assert len(rows) == len(cases.TEXTS)
    by_id = {r.doc_id: r for r in rows}
    texts = {r[0]: r[1] or "" for r in cases.TEXTS}
    ring = sorted((i for i in texts if i is not None), reverse=True) + [None]
    for k, i in enumerate(ring):
        text, after = texts[i], texts[ring[(k + 1) % len(ring)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = by_id[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by_id[1].fingerprint == by_id[2].fingerprint != by_id[3].fingerprint
    assert by_id[4].fingerprint == by_id[5].fingerprint
    assert by_id[7].near_edited > 0.5
    assert multiset_hash.fingerprint_with_edits(cases.empty(spark)).count() == 0


def test_likeness_tells_edits_from_other_texts(spark):
    rows = queries.QUERIES["op7_multiset_fingerprints"](spark, SF_SMALL).where("n_chars > 1000").collect()
    assert sum(r.near_edited for r in rows) / len(rows) > 0.5
    assert sum(r.near_next for r in rows) / len(rows) < 0.2


# --- mixing ------------------------------------------------------------------------------


def _targets_by_rounds(sizes, weights, cap):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * share > cap * sizes[s]]
        if not over:
            return {s: fixed.get(s, weight[s] * share) for s in names}
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 90, None: 1}, {"a": 0, "b": 7}, {"x": 5}, {"a": 1, "b": 1, "c": 1, "d": 10_000}])
def test_targets_equal_resharing_round_by_round(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df, (5.0, 2.0, 1.0), 3).collect()}
    assert got == pytest.approx(_targets_by_rounds(sizes, (5.0, 2.0, 1.0), 3))


def test_mix_on_odd_rows(spark):
    df = cases.frame(spark)
    rows = mix_sources(df, bucket_rows=2).collect()
    assert len(rows) == len(cases.TEXTS)
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(df, bucket_rows=2).collect()))
    assert mix_sources(cases.empty(spark)).count() == 0


def test_better_documents_come_first(spark):
    df = spark.range(400).selectExpr(
        "id AS doc_id", "'s' || id % 2 AS source",
        "CASE WHEN id % 4 < 2 THEN repeat('plain words ', 20) ELSE repeat('12!! 34!! ', 20) END AS text",
    )
    rows = mix_sources(df, (9.0, 1.0)).join(df.select("doc_id", "text"), "doc_id").where("source = 's1'").collect()
    good = sum(r.taken for r in rows if r.text[0] == "p")
    assert good > 2 * sum(r.taken for r in rows if r.text[0] == "1")


def test_mixed_documents_have_the_words_taken(spark):
    df = cases.frame(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    taken = {r.doc_id: r.taken for r in mix_sources(df).collect()}
    out = mixed_documents(df)
    assert out.columns == df.columns
    words, texts = Counter(), {r.doc_id: r.text or "" for r in df.collect()}
    for r in out.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0d]+", r.text))
        assert texts[r.doc_id].startswith(r.text)
    assert words == {i: n for i, n in taken.items() if n}
    assert mixed_documents(cases.empty(spark)).count() == 0


def test_bucket_loads_are_bounded(spark):
    spread = [sum(1 - 2.718281828 ** (-k * w) for w in mixing.WEIGHT_STEPS) / 10 for k in (0.0, 0.1, 1.0, 10.0, 100.0)]
    assert spread == sorted(spread) and 0 <= spread[0] and spread[-1] <= 1
