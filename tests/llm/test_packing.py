"""Packing: the tokenizer's own ids, exact round trips, the curve and the best fit."""

from __future__ import annotations

import os
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_SMALL

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import cases  # noqa: E402

from ledgerlens.llm import queries  # noqa: E402
from ledgerlens.llm.bfd_packing import best_fit_decreasing, pack_best_fit, write_packed  # noqa: E402
from ledgerlens.llm.hilbert_packing import hilbert_key, pack_along_curve, powers_of_two  # noqa: E402
from ledgerlens.llm.tokens import Tokenizer  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "It's İstanbul Σίσυφος ΣΑΣ naïve café CAFÉ don't 12345 <|endoftext|> a\x1fb\x85c 你好 👍🏽 we'll'S ſtreet K ÿ Ÿ ß ẞ ª²",
    "",
    " ",
    "\n\n",
    "a\tb  c",
    "foo\xa0bar \xa0 x\xa0 é a<|startoftext|>b",
    None,
    "é ́x é",
]


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_library_s(spark, file):
    tokenizer = Tokenizer(public_tokenizers.path(file))
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    ids, bounds = tokenizer.encode(pa.array(texts, pa.string()))
    got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    assert got == [_ids(tokenizer.library, t) for t in texts]


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_goes_from_neighbour_to_neighbour(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    key = hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_powers_of_two():
    assert powers_of_two(0) == [] and powers_of_two(1000) == [512, 256, 128, 64, 32, 8]


def _check_pieces(rows, texts, length):
    library = Tokenizer(PATH).library
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        by_sequence[r.sequence_id].append((r.offset, len(ids)))
        by_doc[r.doc_id].append((r.start, ids, r.doc_tokens))
    used = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n
            at += n
        used += length
        assert at == length or at & (at - 1) == 0
    want = defaultdict(list)
    for i, text, *_ in texts:
        want[i].append([*_ids(library, text), 1])
    for i, docs in want.items():
        assert all(p[2] in {len(d) for d in docs} for p in by_doc[i])
        if len(docs) == 1:
            assert np.concatenate([p[1] for p in sorted(by_doc[i], key=lambda p: p[0])]).tolist() == docs[0]
            assert [p[0] for p in sorted(by_doc[i], key=lambda p: p[0])] == np.cumsum(
                [0, *[len(p[1]) for p in sorted(by_doc[i], key=lambda p: p[0])]]
            )[:-1].tolist()
    assert sum(n for p in by_sequence.values() for _, n in p) == sum(len(d) for docs in want.values() for d in docs)


def test_curve_packing_keeps_every_id(spark):
    rows = pack_along_curve(cases.frame(spark), PATH, length=64).collect()
    _check_pieces(rows, cases.TEXTS, 64)
    assert pack_along_curve(cases.empty(spark), PATH).count() == 0


def test_copies_are_neighbours(spark):
    rows = [(i, f"some words about topic {i % 7} " * 9, "en", "a") for i in range(70)]
    pieces = pack_along_curve(cases.frame(spark, rows), PATH, length=2048).collect()
    order = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    topics = [r.doc_id % 7 for r in order if r.start == 0]
    assert sum(a != b for a, b in zip(topics, topics[1:], strict=False)) <= 7 * 4


def test_packing_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    rows = queries.QUERIES["op1_hilbert_packing"](spark, SF_SMALL).collect()
    library = Tokenizer(PATH).library
    want = {i: len(_ids(library, t)) + 1 for i, t in texts}
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id] and r.length <= 2048
    assert got == want


def test_best_fit_decreasing():
    assert best_fit_decreasing([], 8) == []
    draw = np.random.default_rng(1)
    for _ in range(50):
        lengths = draw.integers(1, 33, draw.integers(1, 80)).tolist()
        free, want = [], []  # the same by linear search
        for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [k for k in range(len(free)) if free[k] >= lengths[piece]]
            best = min(fits, key=lambda k: free[k], default=None)
            if best is None:
                free.append(32)
                want.append([])
                best = len(free) - 1
            free[best] -= lengths[piece]
            want[best].append(piece)
        got = best_fit_decreasing(lengths, 32)
        assert sorted(p for row in got for p in row) == list(range(len(lengths)))
        assert sorted(sum(lengths[p] for p in row) for row in got) == sorted(sum(lengths[p] for p in row) for row in want)


def test_best_fit_packing_keeps_every_id(spark, tmp_path):
    packed = pack_best_fit(cases.frame(spark), PATH, width=64)
    write_packed(packed, str(tmp_path / "packed"))
    library, pieces = Tokenizer(PATH).library, defaultdict(list)
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        ids, positions = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(positions) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        for i, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
            pieces[i].append((start, ids[a:b].tolist()))
        assert not ids[r.n_tokens :].any()
    for i, text, *_ in cases.TEXTS:
        if i != 1:  # repeated
            assert sum((p for _, p in sorted(pieces[i])), []) == [*_ids(library, text), 1]
    assert len(pieces[1]) == 2
    assert pack_best_fit(cases.empty(spark), PATH).count() == 0


def test_best_fit_query_wastes_little(spark):
    rows = queries.QUERIES["op2_bfd_packing"](spark, SF_SMALL).select("n_tokens").collect()
    assert sum(r.n_tokens for r in rows) / (2048 * len(rows)) > 0.95


def _cell_of(key, dims, bits):
    """The cell at a place on the Hilbert curve, one bit after another (the inverse transform)."""
    x = [0] * dims
    for b in range(bits):
        for i in range(dims):
            x[i] |= (key >> (b * dims + dims - 1 - i) & 1) << b
    top = x[-1] >> 1
    for i in range(dims - 1, 0, -1):
        x[i] ^= x[i - 1]
    x[0] ^= top
    q = 2
    while q < 1 << bits:
        for i in range(dims - 1, -1, -1):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q <<= 1
    return x


def test_order_along_the_curve_and_cut_like_brute_force(spark):
    import math

    from ledgerlens.llm import hilbert_packing as hp

    length = 128
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()][:150] + [(500, None), (501, "")]
    library = Tokenizer(PATH).library
    project = hp.Projector(library.get_vocab_size())
    ordered = []
    for i, text in texts:
        ids = _ids(library, text)
        sums = [0.0] * hp.BUCKETS
        for t in ids:
            sums[project.bucket[t]] += project.sign[t]
        size = math.sqrt(sum(s * s for s in sums)) or 1.0
        cell = []
        for k in range(hp.DIMENSIONS):
            place = math.tanh(sum(s / size * a for s, a in zip(sums, project.axes[:, k], strict=True)))
            cell.append(min(max(int((place + 1) / 2 * (1 << hp.BITS)), 0), (1 << hp.BITS) - 1))
        key = int(hp.hilbert_key(np.array([cell]), hp.BITS)[0])
        assert _cell_of(key, hp.DIMENSIONS, hp.BITS) == cell
        ordered.append((key, i, [*ids, 1]))
    ordered.sort()
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    pieces = sorted(pack_along_curve(frame, PATH, length).collect(), key=lambda r: (r.sequence_id, r.offset))
    # One piece after another, all documents in the curve's order.
    assert [t for r in pieces for t in np.frombuffer(r.ids, "<u4").tolist()] == [t for _, _, ids in ordered for t in ids]
    assert [r.doc_id for r in pieces if r.start == 0] == [i for _, i, _ in ordered]
    ranges = defaultdict(lambda: defaultdict(int))
    for r in pieces:
        ranges[r.sequence_id >> 32][r.sequence_id] += len(r.ids) // 4
    for sizes in ranges.values():
        full, rest = divmod(sum(sizes.values()), length)
        assert [sizes[s] for s in sorted(sizes)] == [length] * full + powers_of_two(rest)
