"""Inner products, ranked search and the Merkle manifest: against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import cases  # noqa: E402

from ledgerlens.llm import merkle_manifest, norm_search, pair_maxscore  # noqa: E402
from ledgerlens.llm.merkle_manifest import dataset_proofs, verified_manifest  # noqa: E402
from ledgerlens.llm.norm_search import Nearest, Vectors, nearest_by_product  # noqa: E402
from ledgerlens.llm.pair_maxscore import Query, Segment, combined_bound, make_block, rank_documents, search_segment  # noqa: E402


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


# --- inner products -----------------------------------------------------------------------


def _products(rows, k=20, every=20, scale=64):
    """By definition: (query, rank, id, score)."""
    whole = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(scale * x) for x in v]
        if sum(x * x for x in w) < 1 << 62:
            whole.append((i, w))
    out = []
    for a, (i, v) in enumerate(whole):
        if i % every == 0:
            scores = [(-sum(x * y for x, y in zip(v, w, strict=False)), j) for b, (j, w) in enumerate(whole) if a != b]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return out


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, row int")


def test_products_like_brute_force(spark):
    draw = np.random.default_rng(3)
    centers = draw.normal(size=(5, 16))
    made = [centers[i % 5] * draw.choice([0.2, 1, 3]) + 0.3 * draw.normal(size=16) for i in range(700)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(made)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # ties
    got = nearest_by_product(_vectors(spark, rows), slab_rows=64, block_queries=16)
    assert _sorted(got.collect()) == _sorted(_products(rows))


def test_products_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.5]), (40, []), (1, None), (2, [1.0, None]), (3, [nan, 1.0]),
        (4, [inf, 1.0]), (None, [9.0, 9.0]), (-20, [-1.0, -0.001]), (5, [3.0e8, 1.0]), (60, [3.0e38, 1.0]), (7, [0.0, 0.0]),
    ]
    assert _sorted(nearest_by_product(_vectors(spark, rows)).collect()) == _sorted(_products(rows))
    assert nearest_by_product(_vectors(spark, rows[4:5])).collect() == []
    assert nearest_by_product(_vectors(spark, [])).collect() == []


def test_bounds_leave_pairs_out_but_no_result():
    draw = np.random.default_rng(5)
    whole = np.floor(64 * draw.normal(size=(400, 24)) * np.geomspace(1, 0.02, 24)).astype("<i8")
    order = np.argsort(-(whole**2).sum(axis=1))
    rotation = np.linalg.svd(whole.astype(float))[2]

    def packed(at):
        at = np.asarray(at, "<i8")
        return Vectors(at.tobytes(), at.tobytes(), whole[at].tobytes(), rotation, [4, 8])

    near = Nearest(packed(range(40)), 5)
    for a in range(0, 400, 50):
        near.meet(packed(order[a : a + 50]))
    assert near.exact_pairs < 0.5 * 40 * 400
    products = whole @ whole.T
    for q in range(40):
        best = sorted(((-products[q, j], j) for j in range(400) if j != q))[:5]
        assert [(-int(s), int(i)) for s, i in best] == list(zip(near.scores[near.of == q].tolist(), near.ids[near.of == q].tolist(), strict=True))


# --- ranked search ------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return [re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t) for t in TERM.findall(text or "")]


def _ranked(docs, items, k=20):
    """By definition: (item, rank, document, score)."""
    held = [(i, Counter(_terms(t))) for i, t in docs if _terms(t)]
    n_docs, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            n, score = sum(c.values()), 0
            m = 75 + (25 * n * n_docs) // words
            for t in _terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def _texts(seed, count, words=60):
    draw = random.Random(seed)
    return [" ".join(f"w{int(draw.paretovariate(0.7)) % 300}" for _ in range(draw.randint(1, words))) for _ in range(count)]


def _tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, score string, n int"),
        spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string"),
    )


def test_ranks_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pair_maxscore, "SEGMENT_DOCS", 64)
    docs = list(enumerate(_texts(1, 500)))
    docs += [(600 + i, docs[3][1]) for i in range(30)]  # ties
    items = list(enumerate(_texts(2, 25, 20))) + [(99, docs[3][1].upper())]
    for item_bytes in (pair_maxscore.ITEM_BYTES, 2000):  # one block, and several
        got = rank_documents(*_tables(spark, docs, items), item_bytes=item_bytes)
        assert _sorted(got.collect()) == _sorted(_ranked(docs, items))


def test_ranks_of_odd_rows(spark):
    docs = [r[:2] for r in cases.TEXTS]
    items = [(1, "Quick BROWN fox, fox; wood"), (2, None), (3, ""), (4, "nowhere else"), (5, "straße früher 文字の文章です İ"), (5, "word1 end"), (6, "id")]
    got = rank_documents(cases.frame(spark), _tables(spark, [], items)[1])
    assert _sorted(got.collect()) == _sorted(_ranked(docs, items))
    assert rank_documents(cases.empty(spark), _tables(spark, [], items)[1]).collect() == []
    assert rank_documents(cases.frame(spark), _tables(spark, [], [])[1]).collect() == []


def test_terms_in_pieces():
    text = "Ab c-d" * 50 + "x" * 40 + " É10 "
    whole = [t for part in pair_maxscore.terms_in(text) for t in part]
    assert [t for part in pair_maxscore.terms_in(text, 7) for t in part] == whole == _terms(text)


def _segment(held, asked, df):
    """A segment of documents given as term counts."""
    block = make_block(asked, df, docs=len(held), words=sum(sum(c.values()) for c in held))
    of = np.array([d for d, c in enumerate(held) for _ in c], np.int64)
    terms = np.array([t for c in held for t in c], np.int64)
    tfs = np.array([x for c in held for x in c.values()], np.int64)
    n = np.array([sum(c.values()) for c in held], np.int64)
    return block, Segment.build(np.arange(len(held)), n, of, terms, tfs, block)


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.dictionaries(st.integers(0, 9), st.integers(1, 5), min_size=1), min_size=1, max_size=30),
    st.dictionaries(st.integers(0, 9), st.integers(1, 3), min_size=1),
)
def test_pair_bound_is_a_bound_and_tighter(held, times):
    df = np.array([sum(t in c for c in held) for t in range(10)])
    block, segment = _segment(held, [times], df)
    query = block.queries[0]
    whole = np.zeros(len(held), np.int64)
    for t in times:
        if t in segment.most:
            places, worth = segment.postings(t)
            whole[places] += times[t] * worth
    with_pairs, without = combined_bound(times, query, segment), combined_bound(times, Query(times, []), segment)
    assert whole.max() <= with_pairs <= without
    for floor in sorted(set(whole.tolist())):
        scores = np.zeros(len(held), np.int64)
        found = search_segment(query, segment, floor, scores)
        high = {int(d) for d in found if scores[d] >= max(1, floor)}
        assert high == {d for d, s in enumerate(whole.tolist()) if s >= max(1, floor)}
        assert all(scores[d] == whole[d] for d in high)


def test_rare_terms_that_never_meet_let_a_segment_be_skipped():
    held = [{0: 1, 2: 1}, {1: 1, 2: 1}] + [{2: 1}] * 8
    block, segment = _segment(held, [{0: 1, 1: 1}], np.array([1, 1, 10] + [0] * 7))
    query = block.queries[0]
    alone = segment.most[0]
    assert combined_bound([0, 1], query, segment) == alone < combined_bound([0, 1], Query(query.times, []), segment)
    scores = np.zeros(len(held), np.int64)
    assert len(search_segment(query, segment, alone + 1, scores)) == 0 and not scores.any()


# --- Merkle manifest ----------------------------------------------------------------------


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(nodes, fan_out):
    """(root, each leaf's siblings before and after it, level by level)."""
    paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + fan_out, len(nodes))) for a in range(0, len(nodes), fan_out)]
        for run in runs:
            for k in run:
                for i in own[k]:
                    paths[i].append((nodes[run[0] : k], nodes[k + 1 : run[-1] + 1]))
        nodes, own = [_sha(*(nodes[k] for k in run)) for run in runs], [[i for k in run for i in own[k]] for run in runs]
    return nodes[0], paths


def _manifest(rows, fan_out=3):
    def leaf(r, text):
        return _sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    sources, roots, out = {}, [], []
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    named = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in named:
        sources[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        roots.append(_tree([leaf(r, r["text"]) for r in sources[s]], fan_out))
    root, upper = _tree([r for r, _ in roots], fan_out) if roots else (None, [])
    for s, (subroot, paths), above in zip(named, roots, upper, strict=True):
        for r, path in zip(sources[s], paths, strict=True):
            mine, i = leaf(r, r["text"]), r["doc_id"]
            shown = mine
            if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and r["text"] is not None:
                shown = leaf(r, r["text"].replace("\n", ""))
            for before, after in path + above:
                shown = _sha(*before, shown, *after)
            proof = _sha(*(d for before, after in path + above for d in before + after))
            out.append((i, mine, subroot, root, proof, shown, shown == root))
    return out


def test_manifest_of_odd_rows(spark):
    docs = cases.frame(spark)
    got = verified_manifest(docs)
    assert _sorted(got.collect()) == _sorted(_manifest([r.asDict() for r in docs.collect()]))
    assert verified_manifest(cases.empty(spark)).collect() == []
    one = docs.where("doc_id = 10")
    assert [tuple(r) for r in verified_manifest(one).collect()] == _manifest([r.asDict() for r in one.collect()])


@pytest.mark.parametrize("rows, sources", [(1, 1), (3, 1), (4, 2), (300, 1), (900, 40)])
def test_manifest_like_brute_force(spark, rows, sources):
    made = [(i * 7 % 1009, f"line {i}\nend" if i % 5 else None, "en", f"s{i * i % sources}" if i % 11 else None, i) for i in range(rows)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    assert _sorted(verified_manifest(docs).collect()) == _sorted(_manifest([r.asDict() for r in docs.collect()]))


@pytest.mark.parametrize("stride", [1, 2, 5])
def test_proofs_of_rows_are_not_written(spark, monkeypatch, stride):
    made = [(i * 7 % 1009, f"line {i}\nend", "en", "a" if i % 7 else None, i) for i in range(900)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    written = []

    def recorded(df):
        out = materialise(df)
        written.append(out.count() if "segment" in out.columns else 0)
        return out

    materialise = merkle_manifest.materialise
    monkeypatch.setattr(merkle_manifest, "materialise", recorded)
    monkeypatch.setattr(merkle_manifest, "STRIDE", stride)
    assert _sorted(verified_manifest(docs).collect()) == _sorted(_manifest([r.asDict() for r in docs.collect()]))
    assert written and sum(written) < len(made)


def test_manifest_of_other_columns_and_fan_out(spark):
    docs = spark.createDataFrame([(i, "b" if i % 2 else "a", str(i)) for i in range(100)], "k long, part string, body string")
    got = dataset_proofs(docs, ("body",), "part", "k", fan_out=2)
    for r in got.select("*", merkle_manifest.folded(merkle_manifest.F.col("leaf"), merkle_manifest.F.col("segment")).alias("back")).collect():
        assert r["leaf"] == _sha(f"{len(str(r['doc_id']))}:{r['doc_id']}") and r["back"] == r["root"] and len(r["segment"]) == 7
    assert got.select("root").distinct().count() == 1 and got.select("subroot").distinct().count() == 2


def test_height_in_whole_numbers(spark):
    counts = [1, 2, 3, 4, 9, 10, 3**20, 3**20 + 1]
    heights = [0, 1, 1, 2, 2, 3, 20, 21]
    df = spark.createDataFrame([(c,) for c in counts], "count long")
    got = df.select(merkle_manifest._height(df["count"], 3).alias("h")).collect()
    assert [r["h"] for r in got] == heights


def test_no_sample_still_gives_exact_products(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(100)]
    got = nearest_by_product(_vectors(spark, rows), sample_rows=0)
    assert _sorted(got.collect()) == _sorted(_products(rows))
    assert norm_search.SAMPLE_ROWS > 0
