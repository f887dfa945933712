"""Line deduplication and the n-gram Jaccard join against brute force."""

from __future__ import annotations

import itertools
import os
import random
import re
import sys
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_SMALL

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import cases  # noqa: E402

from ledgerlens.llm import common, jaccard_trie, line_dedup, links, queries, words  # noqa: E402
from ledgerlens.llm.common import connected_components  # noqa: E402
from ledgerlens.llm.jaccard_trie import SetTrie, jaccard_components  # noqa: E402
from ledgerlens.llm.line_dedup import SegmentIndex, dedup_lines, line_classes, within  # noqa: E402


class Forest:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingles(text, width):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components_by_hand(rows, width, num, den):
    """Component by the rows' ids; rows with equal ids are one."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    forest, holders = Forest(i for i, _ in sets), defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for a, b in {p for h in holders.values() for p in itertools.combinations(h, 2)}:
        x, y = sets[a][1], sets[b][1]
        if den * len(x & y) >= num * len(x | y):
            forest.join(sets[a][0], sets[b][0])
    return sorted(
        ((i, len(shingles(t, width)), None if i is None else forest.find(i)) for i, t in rows), key=str
    )


def altered(text, draw, times, letters="xyz"):
    chars = list(text)
    for _ in range(times):
        at, how = draw.randrange(len(chars) + 1), draw.random()
        if how < 0.3:
            chars.insert(at, draw.choice(letters))
        elif how < 0.6 and len(chars) > 1:
            chars.pop(min(at, len(chars) - 1))
        else:
            chars[min(at, len(chars) - 1)] = draw.choice(letters)
    return "".join(chars)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    draw = random.Random(3)
    for _ in range(6000):
        a = "".join(draw.choices("abc", k=draw.randrange(14)))
        b = altered(a or "a", draw, draw.randrange(6), "abc")
        for k in range(4):
            assert within(a, b, k) == (distance(a, b) <= k), (a, b, k)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_segment_index_loses_no_pair(threshold):
    draw = random.Random(threshold)
    for _ in range(60):
        base = ["".join(draw.choices("ab", k=draw.randint(9, 18))) for _ in range(3)]
        lines = sorted({altered(draw.choice(base), draw, draw.randrange(4), "ab") for _ in range(20)})
        lines = [x for x in lines if len(x) > 2 * threshold]
        index = SegmentIndex(lines, threshold)
        for x in lines:
            assert index.linked(x) == [k for k, y in enumerate(lines) if distance(x, y) <= threshold]


@pytest.mark.parametrize(("threshold", "chars"), [(1, 5), (3, 4), (4, 6)])
def test_segment_index_by_length_loses_no_pair(threshold, chars):
    draw = random.Random(threshold)
    allowed = lambda n: min(threshold, n // chars)
    linked = 0
    for _ in range(60):
        base = ["".join(draw.choices("ab", k=draw.randint(4, 30))) for _ in range(3)]
        lines = sorted({altered(draw.choice(base), draw, draw.randrange(5), "ab") for _ in range(20)})
        lines = [x for x in lines if allowed(len(x))]
        index = SegmentIndex(lines, threshold, chars)
        for x in lines:
            near = [k for k, y in enumerate(lines) if distance(x, y) <= min(allowed(len(x)), allowed(len(y)))]
            assert index.linked(x) == near
            linked += len(near) - 1
    assert linked > 100


def lines_by_hand(rows, threshold, least, chars=None):
    lines = [(i, k, x) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    solid = sorted({x for _, _, x in lines if re.search(r"[^\x20\x09-\x0d]", x)})
    forest = Forest(solid)
    for a, b in itertools.combinations([x for x in solid if len(x) >= least], 2):
        allowed = threshold if chars is None else min(threshold, min(len(a), len(b)) // chars)
        if abs(len(a) - len(b)) <= allowed and within(a, b, allowed):
            forest.join(a, b)
    members = defaultdict(list)
    for i, k, x in lines:
        if x in forest.up:
            members[forest.find(x)].append((i is not None, i or 0, k, i))
    out = []
    for i, k, x in lines:
        if x in forest.up:
            group = members[forest.find(x)]
            first = min(group)
            out.append((i, k, first[3], first[2], len(group), (i, k) == (first[3], first[2])))
        else:
            out.append((i, k, i, k, 1, True))
    return sorted(out, key=str)


@pytest.mark.parametrize(("threshold", "least", "weight"), [(2, 50, 1 << 18), (2, 20, 400), (1, 10, 1 << 18)])
def test_line_classes(spark, threshold, least, weight):
    draw = random.Random(5)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("doc_id < 120").collect()]
    rows += [(1000 + i, altered(t, draw, 6)) for i, t in rows[:40]]
    rows += [(2000 + i, altered("one line of some length that many documents have in nearly the same words", draw, 2)) for i in range(60)]
    rows += [(5000, None), (5001, ""), (5002, "\n \n"), (None, "a\nThe and.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in line_classes(df, threshold, least, chunk_weight=weight).collect()), key=str)
    assert got == lines_by_hand(rows, threshold, least)


def test_line_query_on_all_lines(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF_SMALL).collect()]
    got = sorted((tuple(r) for r in queries.op3_line_dedup(spark, SF_SMALL).collect()), key=str)
    assert got == lines_by_hand(rows, 2, 25, 25)


def test_chars_an_edit_leave_segments_of_a_character(spark):
    with pytest.raises(ValueError):
        line_classes(cases.empty(spark), least_chars=2, chars_an_edit=2)


@pytest.mark.parametrize(("threshold", "chars", "weight"), [(2, 25, 1 << 18), (4, 12, 400), (6, 30, 1 << 18)])
def test_line_classes_by_length(spark, threshold, chars, weight):
    draw = random.Random(5)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("doc_id < 120").collect()]
    rows += [(1000 + i, altered(t, draw, 6)) for i, t in rows[:40]]
    rows += [(2000 + i, altered("one line of some length that many documents have in nearly the same words", draw, 2)) for i in range(60)]
    rows += [(5000, None), (5001, ""), (5002, "\n \n"), (None, "a\nThe and.")]
    rows += [(6000 + i, f"see page {altered('forty two', draw, 1)}\n{altered('the short line of the end', draw, 1)}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in line_classes(df, threshold, 1, chunk_weight=weight, chars_an_edit=chars).collect()), key=str)
    assert got == lines_by_hand(rows, threshold, 1, chars)


def test_lines_on_odd_rows(spark):
    df = cases.frame(spark)
    rows = line_classes(df).collect()
    assert len(rows) == sum(len(t.split("\n")) for _, t, *_ in cases.TEXTS if t is not None)
    out = dedup_lines(df)
    assert out.columns == df.columns
    by_id = {r.doc_id: r.text for r in out.collect()}
    assert 2 not in by_id and by_id[9] == "Straße über München: größer als früher."
    assert by_id[4] is None and by_id[5] == "" and by_id[6] == cases.TEXTS[5][1] and by_id[7] == cases.LONG
    assert out.where("doc_id = 1").count() == 2  # rows of one id stay together
    assert line_classes(cases.empty(spark)).count() == 0 and dedup_lines(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        line_classes(df, threshold=3, least_chars=6)


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100), (1, 2)])
def test_trie_finds_all_links(num, den):
    draw = np.random.default_rng(1)
    for _ in range(60):
        base, sets = np.unique(draw.integers(0, 1 << 62, 60, dtype=np.uint64)), []
        for _ in range(draw.integers(1, 30)):
            s = base[draw.random(len(base)) > draw.random() * 0.3]
            if draw.random() < 0.2:
                s = draw.integers(0, 1 << 62, draw.integers(1, 60), dtype=np.uint64)
            s = np.unique(np.concatenate([s, draw.integers(0, 1 << 62, draw.integers(1, 6), dtype=np.uint64)]))
            sets.append(sets[-1][:-1] if sets and len(sets[-1]) > 1 and draw.random() < 0.3 else s)
        trie = SetTrie(sets, num, den)
        for x in sets:
            want = [i for i, y in enumerate(sets) if den * len(np.intersect1d(x, y)) >= num * len(np.union1d(x, y))]
            assert trie.linked(x).tolist() == want


def test_first_tokens_hold_the_shared_ones():
    """Linked sets share as many first tokens as each is told to need, and sizes' classes touch."""
    draw = random.Random(2)
    for num, den in ((80, 100), (90, 100)):
        for _ in range(150):
            n = draw.choice([draw.randint(1, 60), draw.randint(300, 900)])
            common = draw.sample(range(10_000), n)
            extra = draw.randint(0, max(0, n * (den - num) // num))
            split = draw.randint(0, extra)
            a = sorted(common + draw.sample(range(10_000, 20_000), split))
            b = sorted(common + draw.sample(range(20_000, 30_000), extra - split))
            draw.shuffle(order := list(range(30_000)))
            key = lambda x, order=order: order[x]
            assert den * n >= num * len(set(a) | set(b))
            heads = [sorted(s, key=key)[: jaccard_trie.first_tokens(len(s), num, den)] for s in (a, b)]
            shared = len(set(heads[0]) & set(heads[1]))
            for s in (a, b):
                smallest = -(-num * len(s) // den)
                assert shared >= jaccard_trie.shared_at_least(smallest, num, den)


@pytest.mark.parametrize(("width", "num", "weight"), [(3, 90, 1 << 18), (5, 80, 1 << 18), (3, 80, 300)])
def test_components(spark, width, num, weight):
    draw = random.Random(7)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    vocabulary = [f"w{i}" for i in range(3000)]
    base = draw.choices(vocabulary, k=120)
    for i in range(80):  # one large group of near copies, at similarities around the threshold
        own = list(base)
        for _ in range(draw.randrange(9)):
            own[draw.randrange(len(own))] = draw.choice(vocabulary)
        rows.append((1000 + i, " ".join(own)))
    rows += [(2000 + i, " ".join(draw.choices(["a", "b", "c"], k=draw.randint(1, 5)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_components(df, width, num, 100, chunk_weight=weight).collect()), key=str)
    assert got == components_by_hand(rows, width, num, 100)


def test_texts_of_one_id_link_each_by_its_size(spark):
    texts = [" ".join(f"{name}{k}" for k in range(n)) for name, n in (("s", 60), ("l", 600))]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0] + " end"), (3, texts[1] + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_components(df, 3, 90, 100).collect()), key=str)
    assert got == components_by_hand(rows, 3, 90, 100) and {r[2] for r in got} == {1}


def test_components_on_odd_rows(spark):
    df = cases.frame(spark)
    rows = [r[:2] for r in cases.TEXTS]
    got = sorted((tuple(r) for r in jaccard_components(df, 3, 90, 100).collect()), key=str)
    assert got == components_by_hand(rows, 3, 90, 100)
    assert jaccard_components(cases.empty(spark)).count() == 0


def test_jaccard_query(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF_SMALL).collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op9_jaccard_trie"](spark, SF_SMALL).collect()), key=str)
    assert got == components_by_hand(rows, 3, 90, 100)


def test_words_and_shingles_of_many_texts():
    texts = ["A b\tc", None, "", "  one ", "é\x1fx \x85 Z", "a B C d e"]
    hashes, bounds = words.word_hashes(pa.array(texts))
    assert np.diff(bounds).tolist() == [len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for t in texts]
    assert hashes[bounds[0] : bounds[0] + 3].tolist() == hashes[bounds[5] : bounds[5] + 3].tolist()
    tokens, ends = words.shingle_hashes(hashes, bounds, 3, np.zeros(len(hashes), np.int64))
    assert np.diff(ends).tolist() == [1, 0, 0, 1, 1, 3]
    assert tokens[0] == tokens[ends[5]]


def test_links_of_a_block_span_its_components():
    find = lambda payloads: lambda p: [i for i, q in enumerate(payloads) if abs(int(q) - int(p)) <= 1]
    edges, parts = links.link_block([b"5", b"1", b"2", b"9", b"3", b"6"], find)
    assert len(edges) == 3
    assert parts.label[0] == parts.label[5] and parts.label[1] == parts.label[2] == parts.label[4] != parts.label[3]


def test_leftovers_pass_by_a_chunk_unkept():
    """A task's memory holds the chunk's own rows and a batch, not all guests."""
    own = [(1, 0, 9, 5, k, b"own%d" % k + bytes(20_000), False, 0) for k in range(3)]

    def batches():
        yield links._dealt(own)
        for k in range(200):
            payloads = [b"own%d" % (j % 3) + bytes(20_000) if j == 7 else b"%d-%d" % (k, j) + bytes(20_000) for j in range(50)]
            yield links._dealt([(1, 0, 9, 5, 100 + 50 * k + j, p, True, 0) for j, p in enumerate(payloads)])

    find = lambda payloads: lambda p: [i for i, q in enumerate(payloads) if q == p]
    tracemalloc.start()
    got = [tuple(r.values()) for b in links._link_leftovers(find)(batches()) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(1, 0, 100 + 50 * k + 7, 1) for k in range(200)]
    assert peak < 20e6  # all guests: 200 MB


def test_guests_are_dealt_without_a_list_of_chunks():
    homes = [{"block": 1, "chunk": 2, "chunks": 5, "center": 0, "probe": True, "slice": 3, "slices": 4}]
    homes += [{"block": 7, "chunk": 1, "chunks": 2, "center": 0, "probe": False, "slice": 0, "slices": 3}]
    (batch,) = links.deal_rows([(8, b"x", homes)])
    got = [(r["block"], r["chunk"], r["slice"], r["probe"]) for r in batch.to_pylist()]
    assert got == [(1, c, 3, True) for c in (0, 1, 3, 4)] + [(7, 1, k, False) for k in range(3)]


def test_unlinked_lines_under_one_hot_key(spark, monkeypatch):
    """Templated lines, most of them unlinked: many chunks and slices, and no link lost."""
    monkeypatch.setattr(links, "SLICE_CHUNKS", 1)
    draw = random.Random(11)
    word = lambda n: "".join(draw.choices("abcdefgh", k=n))
    lines = ["the very same words" + word(41) for _ in range(150)]
    lines += [altered(x, draw, 2, "xyz") for x in lines[:60]]
    rows = [(i, x) for i, x in enumerate(draw.sample(lines, len(lines)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in line_classes(df, 2, 50, chunk_weight=600).collect()), key=str)
    assert got == lines_by_hand(rows, 2, 50)
    assert sum(r[4] > 1 for r in got) > 100


def test_connected_components(spark):
    draw = random.Random(9)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)]
    edges += [(1000, i) for i in range(1001, 1100)]
    forest = Forest({x for e in edges for x in e})
    for a, b in edges:
        forest.join(a, b)
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: forest.find(x) for e in edges if e[0] != e[1] for x in e}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_lines_whose_polynomial_hashes_agree_are_different(spark):
    line = _thue_morse(1 << 11)
    other = line.translate({97: 98, 98: 97})
    sums = words.prefix_sums(np.frombuffer((line + other).encode(), np.uint8))
    n = len(line)
    assert len(set(words.substring_hashes(sums, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 1  # they do agree
    docs = spark.createDataFrame([(1, line), (2, other), (3, f"x\n{other}")], "doc_id long, text string")
    rows = {(r.doc_id, r.line_no): (r.keep_doc_id, r.class_size, r.kept) for r in line_classes(docs).collect()}
    assert rows == {(1, 0): (1, 1, True), (2, 0): (2, 2, True), (3, 0): (3, 1, True), (3, 1): (2, 2, False)}
    kept = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert kept == {1: line, 2: other, 3: "x"}
    # As words of a document, too.
    made = spark.createDataFrame([(1, f"{line} a b"), (2, f"{other} a b")], "doc_id long, text string")
    assert {r.component_id for r in jaccard_components(made).collect()} == {1, 2}


def test_lines_of_one_number_stay_apart(spark, monkeypatch):
    """Different lines whose first 64 bits agree: neither goes, and neither is linked."""
    from ledgerlens.llm import line_dedup

    base = "a line that is long enough for the edit join to look at it, number "
    docs = spark.createDataFrame([(i, base + str(i)) for i in range(3)], "doc_id long, text string")
    assert line_classes(docs).where("kept").count() == 1
    numbered = line_dedup._occurrences

    def one_number(batches):
        for batch in numbered(batches):
            yield batch.set_column(2, "id", pa.array([7] * len(batch), pa.int64()))

    monkeypatch.setattr(line_dedup, "_occurrences", one_number)
    assert line_classes(docs).where("kept").count() == 3


def test_a_text_of_very_many_lines_is_cut_in_one_pass(spark):
    lines = [f"line number {i // 2} of this text" for i in range(60_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    assert dedup_lines(docs).first()["text"] == "\n".join(lines[::2])


def test_a_tasks_table_travels_packed(monkeypatch):
    """Mostly zeros: a row of it is a small part of the block's bytes, and unpacks to its numbers."""
    monkeypatch.setattr(common, "TaskContext", type("Here", (), {"get": staticmethod(lambda: Here())}))

    class Here:
        def partitionId(self):
            return 5

    table = np.zeros(1 << 16, np.uint64)
    table[::997] = np.arange(len(table[::997])) + 1
    batches = list(common.table_rows(table, 4, 2))
    values = [b.column(2)[0].as_py() for b in batches]
    assert [b.column(1)[0].as_py() for b in batches] == [1] * 4
    assert max(map(len, values)) < table.nbytes // 4 // 20
    assert np.array_equal(np.concatenate([common.table_values(v, "<u8") for v in values]), table)


def test_texts_of_lines_are_not_hashed_by_substrings(monkeypatch):
    """Only keys need the prefix sums; the pass that fetches the lines does without."""

    def never(data):
        raise AssertionError("prefix sums")

    texts = ["a line of more than ten\n \t \x0b \x0c         \nshort", "a line of more than ten\nand a second line é😀".encode("utf-16", "surrogatepass").decode("utf-16")]
    monkeypatch.setattr(line_dedup, "prefix_sums", never)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts)], names=["doc_id", "text"])
    every = type("Every", (), {"value": np.full(1 << 21, 255, np.uint8)})
    got = [line.decode() for b in line_dedup._lines_in(every, 10)(iter([batch])) for line in b.column(2).to_pylist()]
    assert got == ["a line of more than ten", "and a second line é\U0001f600"]


@pytest.mark.parametrize("chars", [None, 5])
def test_keys_are_the_windows_segments(chars):
    """As many keys a line as there are places for the segments of each length it may link with."""
    lines = ["".join(random.Random(n).choices("abcdef", k=n)) for n in range(8, 40)]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["\n".join(lines)])], names=["doc_id", "text"])
    made = pa.Table.from_batches(list(line_dedup._keys(2, 8, chars)(iter([batch]))))
    by_length = defaultdict(int)
    for n in made.column("weight").to_pylist():
        by_length[n] += 1
    for n in range(8, 40):
        want = 0
        for delta in range(3):
            t = line_dedup.edits(n - delta, 2, chars)
            if t >= max(delta, 1):
                want += sum(len(line_dedup.window(i, a, size, delta, t, n)) for i, (a, size) in enumerate(line_dedup.segments(n - delta, t + 1)))
        assert by_length[n] == want, n
