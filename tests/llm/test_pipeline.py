"""The pipeline's stages against plain re-computations, on a small table with planted cases."""

from __future__ import annotations

import os
import random
import re
import sys
from collections import Counter, defaultdict

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import cases  # noqa: E402
from test_duplicates import components_by_hand, lines_by_hand  # noqa: E402

import corpus_pipeline  # noqa: E402
from ledgerlens.llm import queries  # noqa: E402
from ledgerlens.llm.line_dedup import LEAST_CHARS, THRESHOLD  # noqa: E402
from ledgerlens.llm.mixing import mix_sources  # noqa: E402

SF = "/root/testdata/sf0.001"
GREEK = "Ὁ βίος βραχύς, ἡ δὲ τέχνη μακρή, ὁ δὲ καιρὸς ὀξύς, ἡ δὲ πεῖρα σφαλερή. " * 6


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The smallest documents, with near copies, texts of another script and empty ones."""
    draw = random.Random(1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    more = []
    for k, (_, text, lang, _, _) in enumerate(rows[:30]):
        words = text.split(" ")
        for _ in range(2):
            words[draw.randrange(len(words))] = "changed"
        near = " ".join(words)
        more.append((10_000 + k, near, lang, "near", len(near)))
    more += [(20_000, GREEK, None, "odd", len(GREEK)), (20_001, "", "en", "odd", 0), (20_002, None, "en", None, None)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows + more, docs.schema).write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(name, rows in, rows out, columns) of each stage, each from the one before."""
    from ledgerlens.llm.common import materialise

    docs = queries.documents(spark, sf_dir)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = materialise(stage(spark, docs, sf_dir))
        out[name] = (docs.collect(), made.collect(), made.columns)
        docs = made
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    for name in list(stages)[:-1]:
        assert stages[name][2] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_drops_only_what_is_no_language(stages):
    before, after, _ = stages["language_id"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {20_000, 20_001, 20_002}
    assert set(after) <= set(before)


def test_line_stage(stages):
    before, after, _ = stages["line_dedup"]
    kept = defaultdict(list)
    lines = lines_by_hand([(r.doc_id, r.text) for r in before], THRESHOLD, LEAST_CHARS)
    for i, k, *_, stays in lines:
        if stays:
            kept[i].append(k)
    want = {}
    for r in before:
        every = r.text.split("\n")
        rest = "\n".join(every[k] for k in sorted(kept[r.doc_id]))
        if rest.strip(" \t\n\x0b\x0c\r") or len(kept[r.doc_id]) == len(every):
            want[r.doc_id] = rest
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_duplicate_stage(stages):
    before, after, _ = stages["near_duplicates"]
    groups = components_by_hand([(r.doc_id, r.text) for r in before], 5, 80, 100)
    assert sorted(r.doc_id for r in after) == sorted(i for i, _, c in groups if i == c)
    assert set(after) <= set(before)


def test_mix_stage(spark, stages):
    before, after, _ = stages["source_mix"]
    frame = spark.createDataFrame(before)
    taken = {r.doc_id: r.taken for r in mix_sources(frame, queries.MIX_WEIGHTS, queries.MIX_EPOCHS).collect()}
    words = Counter()
    for r in after:
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0d]+", r.text))
    assert words == {i: n for i, n in taken.items() if n}


def test_packing_stage(stages):
    before, after, _ = stages["packing"]
    docs, pieces = Counter(r.doc_id for r in before), defaultdict(int)
    for r in after:
        pieces[r.doc_id] += r.length
    assert set(pieces) == set(docs)


def test_run_gives_the_last_stage_s_rows(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sum(r.length for r in got) == sum(r.length for r in stages["packing"][1])
    assert {key(r)[0] for r in got} == {key(r)[0] for r in stages["packing"][1]}


def test_near_duplicates_keep_one_row_of_a_repeated_id(spark):
    unnamed = [(None, "Another text without an id, of words that no other text has.", "en", "a")] * 2
    rows = corpus_pipeline.near_duplicates(spark, cases.frame(spark, cases.TEXTS + unnamed), "").collect()
    ids = Counter(r.doc_id for r in rows)
    assert ids.pop(None) == 3 and ids[1] == 1 and 2 not in ids
    assert set(ids.values()) == {1}


def test_stages_on_odd_rows(spark):
    docs = cases.frame(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, cases.empty(spark), "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= len(cases.TEXTS)
    assert corpus_pipeline.STAGES[-1][1](spark, cases.empty(spark), "").count() == 0
