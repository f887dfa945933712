"""Ranked lexical search with pair-bound MaxScore.

Scores are whole numbers: a term's weight falls with the documents that hold it, its impact
on a document rises with its occurrences there and falls with the document's length; a
document's score for an item is the sum of the impacts of the item's terms, repeats included.

The index over the items' terms is a table of segments, one row for some thousand documents:
postings of each term with impacts and their maximum, and, for pairs of the heaviest terms of
an item, the intersection list: the documents that hold both, their joint impacts and the
joint maximum. Two rare terms seldom meet in a document, so the pair's bound, the largest of
the joint maximum and of either term alone, is well below the sum of both maxima.

A query first takes a floor for its k-th score from the intersection lists: a document
scores at least what one of its pairs gives. Then, segment by segment, the terms' maxima are
combined to a bound, the pairs that save most replacing their two terms: a segment whose
bound is under the floor is skipped; the terms of least impact whose combined bound is under
the floor only add to documents that other terms have found, and documents that cannot reach
the floor any more are left at each step. A task keeps k documents an item over its segments.

Items are taken in blocks of bounded size, each with one pass over the documents, so what the
tasks get of the items has a bound whatever their number.

Edge cases: a null text, or one without a term, has no terms, counts nowhere and is never
found; an item without terms, or whose terms no document holds, has no rows. Rows that repeat
an item are ranked each on their own, a null item_id as well. Rows that repeat a doc_id are
documents of their own. A document without an id counts in all statistics, but cannot be
named and is not ranked. Texts are read whole, in pieces. Equal scores stand by ascending
doc_id. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise
from .tokens import text_parts

K = 20
#: So many of an item's heaviest terms have their pairs' intersections stored.
PAIRED_TERMS = 8
#: Bytes of items' texts that are searched for at once.
ITEM_BYTES = 4 << 20
#: A segment ends at so many documents or postings.
SEGMENT_DOCS = 8192
SEGMENT_POSTINGS = 1 << 19
PIECE_CHARS = 1 << 20

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms_in(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[list[str]]:
    """The terms of a text, in lists of bounded length (but for a longer single term)."""
    low = text.lower() if text.isascii() else text.translate(LOWER)
    start = 0
    while start < len(low):
        end = len(low)
        if end - start > piece_chars:
            after = BETWEEN.search(low, start + piece_chars)
            end = after.start() if after else end
        yield TERM.findall(low, start, end)
        start = end


def weight(docs: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * with_term + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """What occurrences ``tf`` of terms add to the scores of documents of ``n`` terms."""
    m = 100 - 25 + (25 * n * docs) // words
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


@dataclass
class Query:
    """An item's terms (numbers in the block's vocabulary) with their repeats, and the pairs
    (number of the pair, two terms) that have intersection lists."""

    times: dict[int, int]
    pairs: list[tuple[int, int, int]]


@dataclass
class Block:
    """What the tasks get of a block of items."""

    queries: list[Query]
    weights: np.ndarray
    #: By pair: two terms, in the order of the first.
    pairs: np.ndarray
    docs: int
    words: int
    floors: np.ndarray


def _vocabulary(texts: Sequence[str | None]) -> tuple[dict[str, int], list[dict[int, int]]]:
    known: dict[str, int] = {}
    asked = []
    for text in texts:
        counts: Counter[str] = Counter()
        for part in terms_in(text or ""):
            counts.update(part)
        asked.append({known.setdefault(t, len(known)): c for t, c in counts.items()})
    return known, asked


def make_block(asked: Sequence[dict[int, int]], with_term: np.ndarray, docs: int, words: int, paired: int = PAIRED_TERMS) -> Block:
    weights = np.array([weight(docs, int(d)) if d else 0 for d in with_term], np.int64)
    chosen = []
    for times in asked:
        heavy = sorted((t for t in times if weights[t] > 0), key=lambda t: (-weights[t], t))[:paired]
        chosen.append(list(combinations(sorted(heavy), 2)))
    number = {p: i for i, p in enumerate(sorted({p for pairs in chosen for p in pairs}))}
    queries = [Query(times, [(number[p], *p) for p in pairs]) for times, pairs in zip(asked, chosen, strict=True)]
    pairs = np.array(list(number), np.int64).reshape(-1, 2)
    return Block(queries, weights, pairs, docs, words, np.zeros(len(queries), np.int64))


def _forward(vocabulary: Broadcast):
    """(doc_id, n, terms, tfs): a document's number of terms, and the block's terms in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for ids, texts in text_parts(batches):
            sizes, bounds, terms, tfs = [], [0], [], []
            for text in texts.to_pylist():
                counts: Counter[str] = Counter()
                size = 0
                for part in terms_in(text or ""):
                    size += len(part)
                    counts.update(filter(known.__contains__, part))
                sizes.append(size)
                terms += map(known.__getitem__, counts)
                tfs += counts.values()
                bounds.append(len(terms))
            at = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return run


#: A segment's arrays as bytes: little-endian numbers of these types.
PARTS = {
    "doc_ids": "<i8",
    "terms": "<i4",
    "term_bounds": "<i4",
    "places": "<i4",
    "impacts": "<i8",
    "term_most": "<i8",
    "pairs": "<i4",
    "pair_bounds": "<i4",
    "pair_places": "<i4",
    "pair_impacts": "<i8",
    "pair_most": "<i8",
}
SEGMENT_COLUMNS = ", ".join(f"{name} binary" for name in PARTS)


class Segment:
    """Postings and intersection lists of some documents."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.doc_ids = arrays["doc_ids"]
        self._places, self._impacts = arrays["places"], arrays["impacts"]
        bounds = arrays["term_bounds"].tolist()
        self._slices = {t: slice(a, b) for t, a, b in zip(arrays["terms"].tolist(), bounds, bounds[1:], strict=False)}
        self.most = dict(zip(arrays["terms"].tolist(), arrays["term_most"].tolist(), strict=True))
        self.pair_most = dict(zip(arrays["pairs"].tolist(), arrays["pair_most"].tolist(), strict=True))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = self._slices[term]
        return self._places[at], self._impacts[at]

    def intersection(self, pair: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, joint impacts) of the documents that hold both terms."""
        if pair not in self.pair_most:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        k = int(np.searchsorted(self.arrays["pairs"], pair))
        a, b = self.arrays["pair_bounds"][k : k + 2]
        return self.arrays["pair_places"][a:b], self.arrays["pair_impacts"][a:b]

    @staticmethod
    def build(doc_ids: np.ndarray, n: np.ndarray, of: np.ndarray, terms: np.ndarray, tfs: np.ndarray, block: Block) -> Segment:
        """From postings (place of the document, term, occurrences), documents in order."""
        worth = impacts(block.weights[terms], tfs, n[of], block.docs, block.words)
        kept = worth > 0
        of, terms, worth = of[kept], terms[kept], worth[kept]
        order = np.argsort(terms, kind="stable")
        of, terms, worth = of[order], terms[order], worth[order]
        held, first = np.unique(terms, return_index=True)
        bounds = np.append(first, len(terms))
        where = dict(zip(held.tolist(), zip(bounds, bounds[1:], strict=False), strict=False))
        spot = np.full(len(doc_ids), -1)
        pairs, pair_bounds, places, joint, most, last = [], [0], [], [], [], None
        for p, (a, b) in enumerate(block.pairs.tolist()):
            if a not in where or b not in where:
                continue
            if a != last:  # pairs come in the order of their first term
                if last is not None:
                    spot[of[slice(*where[last])]] = -1
                spot[of[slice(*where[a])]] = np.arange(*where[a])
                last = a
            both = spot[of[slice(*where[b])]]
            here = both >= 0
            if here.any():
                places.append(of[slice(*where[b])][here])
                joint.append(worth[slice(*where[b])][here] + worth[both[here]])
                pairs.append(p)
                pair_bounds.append(pair_bounds[-1] + int(here.sum()))
                most.append(int(joint[-1].max()))
        none = [np.zeros(0, np.int64)]
        return Segment(
            {
                "doc_ids": doc_ids,
                "terms": held,
                "term_bounds": bounds,
                "places": of,
                "impacts": worth,
                "term_most": np.maximum.reduceat(worth, first) if len(held) else worth,
                "pairs": np.array(pairs, np.int64),
                "pair_bounds": np.array(pair_bounds),
                "pair_places": np.concatenate(places or none),
                "pair_impacts": np.concatenate(joint or none),
                "pair_most": np.array(most, np.int64),
            }
        )

    def row(self) -> pa.RecordBatch:
        made = [pa.array([self.arrays[name].astype(kind).tobytes()], pa.binary()) for name, kind in PARTS.items()]
        return pa.RecordBatch.from_arrays(made, names=list(PARTS))


def segments_in(batches: Iterable[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for k in range(len(batch)):
            yield Segment({name: np.frombuffer(batch.column(i)[k].as_buffer(), kind) for i, (name, kind) in enumerate(PARTS.items())})


def _segments(block: Broadcast):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            terms, tfs = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            ends = np.cumsum(lengths)
            a = 0
            while a < len(ids):
                before = int(ends[a] - lengths[a])
                b = int(np.searchsorted(ends, before + SEGMENT_POSTINGS, side="right"))
                b = min(max(b, a + 1), a + SEGMENT_DOCS, len(ids))
                cut = slice(before, int(ends[b - 1]))
                of = np.repeat(np.arange(b - a), lengths[a:b])
                yield Segment.build(ids[a:b], n[a:b], of, terms[cut], tfs[cut], block.value).row()
                a = b

    return run


def combined_bound(terms: Iterable[int], query: Query, segment: Segment) -> int:
    """The most that a document of the segment can get from ``terms``: the sum of their maxima,
    less what the pairs that save most, no term in two of them, take off."""
    alone = {t: query.times[t] * segment.most[t] for t in terms if t in segment.most}
    savings = []
    for p, a, b in query.pairs:
        if a in alone and b in alone:
            joint, ta, tb = segment.pair_most.get(p, 0), query.times[a], query.times[b]
            if joint:  # the pair counts min times, the rest of the more frequent term alone
                joint = min(ta, tb) * joint + max(0, ta - tb) * segment.most[a] + max(0, tb - ta) * segment.most[b]
            saved = alone[a] + alone[b] - max(alone[a], alone[b], joint)
            if saved > 0:
                savings.append((saved, a, b))
    bound, taken = sum(alone.values()), set()
    for saved, a, b in sorted(savings, reverse=True):
        if a not in taken and b not in taken:
            taken.update((a, b))
            bound -= saved
    return bound


def best(scores: np.ndarray, doc_ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, equal ones by ascending doc_id."""
    return np.lexsort((doc_ids, -scores))[:k]


def search_segment(query: Query, segment: Segment, floor: int, scores: np.ndarray, use_pairs: bool = True) -> np.ndarray:
    """Places of the documents whose score may be ``floor`` or more and is above 0, their whole
    scores in ``scores`` (zeros before; the caller clears what was touched)."""
    asked = query if use_pairs else Query(query.times, [])
    terms = sorted((t for t in query.times if t in segment.most), key=lambda t: query.times[t] * segment.most[t])
    if not terms or combined_bound(terms, asked, segment) < floor:
        return np.zeros(0, np.int64)
    # bounds[i]: the most that the i terms of least impact can add.
    bounds = [combined_bound(terms[:i], asked, segment) for i in range(len(terms))]
    lead = max(i for i, bound in enumerate(bounds) if bound < floor or i == 0)
    for t in terms[lead:]:
        places, worth = segment.postings(t)
        scores[places] += query.times[t] * worth
    found = np.flatnonzero(scores)
    for i in range(lead, 0, -1):
        reach = scores[found] + bounds[i] >= floor
        scores[found[~reach]] = 0
        found = found[reach]
        places, worth = segment.postings(terms[i - 1])
        at = np.minimum(np.searchsorted(places, found), len(places) - 1)
        scores[found] += np.where(places[at] == found, query.times[terms[i - 1]] * worth[at], 0)
    return found


class Found:
    """The best documents of each query so far."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.copy()
        self.scores = [np.zeros(0, np.int64) for _ in floors]
        self.doc_ids = [np.zeros(0, np.int64) for _ in floors]

    def add(self, q: int, scores: np.ndarray, doc_ids: np.ndarray) -> None:
        scores, doc_ids = np.append(self.scores[q], scores), np.append(self.doc_ids[q], doc_ids)
        kept = best(scores, doc_ids, self.k)
        self.scores[q], self.doc_ids[q] = scores[kept], doc_ids[kept]
        if len(kept) == self.k:
            self.floors[q] = max(self.floors[q], int(self.scores[q][-1]))

    def rows(self) -> pa.RecordBatch:
        which = np.repeat(np.arange(len(self.floors), dtype=np.int32), [len(s) for s in self.scores])
        none = [np.zeros(0, np.int64)]
        columns = [which, np.concatenate(self.doc_ids or none), np.concatenate(self.scores or none)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "doc_id", "score"])


FOUND_COLUMNS = "query int, doc_id long, score long"


def _pair_floors(block: Broadcast, k: int):
    """Of each query, the documents that some pair of it gives the most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(block.value.floors, k)
        for segment in segments_in(batches):
            most = np.zeros(len(segment.doc_ids), np.int64)
            for q, query in enumerate(block.value.queries):
                touched = []
                for p, _, _ in query.pairs:
                    if segment.pair_most.get(p, 0) > found.floors[q]:
                        places, joint = segment.intersection(p)
                        most[places] = np.maximum(most[places], joint)
                        touched.append(places)
                if touched:
                    places = np.unique(np.concatenate(touched))
                    found.add(q, most[places], segment.doc_ids[places])
                    most[places] = 0
        yield found.rows()

    return run


def _search(block: Broadcast, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(block.value.floors, k)
        for segment in segments_in(batches):
            scores = np.zeros(len(segment.doc_ids), np.int64)
            for q, query in enumerate(block.value.queries):
                places = search_segment(query, segment, int(found.floors[q]), scores)
                high = places[scores[places] >= max(1, found.floors[q])]
                if len(high):
                    found.add(q, scores[high], segment.doc_ids[high])
                scores[:] = 0
        yield found.rows()

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: list, k: int, paired: int) -> DataFrame:
    """(query, rank, doc_id, score) for the items of one block; ``query`` is the place in it."""
    spark = docs.sparkSession
    known, asked = _vocabulary([i["text"] for i in items])
    vocabulary = spark.sparkContext.broadcast(known)
    forward = materialise(docs.mapInArrow(_forward(vocabulary), "doc_id long, n long, terms array<int>, tfs array<long>"))
    totals = forward.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
    with_term = np.zeros(len(known), np.int64)
    for row in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the vocabulary's size
        with_term[row["term"]] = row["count"]
    block = make_block(asked, with_term, totals["docs"], totals["words"] or 1, paired)
    shared = spark.sparkContext.broadcast(block)
    ranked = forward.where("doc_id IS NOT NULL AND n > 0")
    segments = materialise(ranked.mapInArrow(_segments(shared), SEGMENT_COLUMNS))
    floors = _top(segments.mapInArrow(_pair_floors(shared, k), FOUND_COLUMNS), k).where(F.col("rank") == k)
    block.floors = np.zeros(len(asked), np.int64)
    for row in floors.collect():  # one row a query
        block.floors[row["query"]] = row["score"]
    raised = spark.sparkContext.broadcast(block)
    return _top(segments.mapInArrow(_search(raised, k), FOUND_COLUMNS), k)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    item_bytes: int = ITEM_BYTES,
    paired: int = PAIRED_TERMS,
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: the ``k`` documents of highest score
    above 0 for each item; all, if fewer."""
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = materialise(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL"))
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // item_bytes))
    asked = materialise(asked.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))))
    spark, out = docs.sparkSession, []
    for b in range(blocks):
        these = asked.where(F.col("block") == b).collect()  # about item_bytes
        named = [(k, row["item_id"]) for k, row in enumerate(these)]
        named = spark.createDataFrame(named, f"query int, item_id {dict(asked.dtypes)['item_id']}")
        found = _search_block(raw, these, k, paired)
        out.append(found.join(F.broadcast(named), "query").select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)
