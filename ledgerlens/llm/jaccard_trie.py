"""N-gram Jaccard join by prefix trees.

A document is its set of word shingles, as tokens in one global order, rare words first:
the order's first byte comes from a fixed-size table of word counts over the whole table,
the rest is a hash. Two sets at the threshold share several of their first tokens, so these
tokens are the keys of :mod:`.links`; their sizes are alike, so blocks are parted by size.
In a block the sets are stored, frequent tokens
first, in a trie whose edges hold runs of tokens; looking up a set goes down the trie once,
sharing the overlap with common beginnings, and leaves a subtree when even the tokens that
remain on both sides cannot reach the threshold.

Equal sets are one record (by a 128-bit digest) until the end, so copies cost nothing.

Edge cases: a null, empty or blank text has no shingles and links with nothing; one of
fewer words than a shingle has all of them as its one shingle. Rows that share a doc_id
share a component; a null doc_id has a null component. An empty table gives an empty
result. Only the id and text columns are read. Shingles are compared by 56 bits of a hash of
their words' 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import links
from .common import TABLE_COLUMNS, arrow_rows, connected_components, few_tasks, materialise, returning_memory, summed_tables, table_rows, table_values
from .words import parts, shingle_hashes, word_hashes

#: So many first tokens two linked sets must share, the more of long ones: the larger of the
#: number and the share of the size (or the whole overlap, if that is less).
SHARED_KEYS = 8
SHARED_PART = 20
#: Word counts are kept in so many buckets (a power of two), whatever the table's size.
TABLE_BITS = 22
BLOCKS = 64
#: First-level sums of the table's blocks, before the last.
PARTIAL_SUMS = 16


class SetTrie:
    """Sets of tokens (sorted arrays), frequent tokens first, with shared beginnings stored once."""

    def __init__(self, sets: Sequence[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        sequences = [s[::-1] for s in sets]
        order = sorted(range(len(sets)), key=lambda i: sequences[i].astype(">u8").tobytes())
        parent, start, end, source = [-1], [0], [0], [0]
        self.node_of = np.zeros(len(sets), np.int64)
        path = [0]
        before = sequences[order[0]][:0]
        for i in order:
            s = sequences[i]
            n = min(len(s), len(before))
            differs = np.flatnonzero(s[:n] != before[:n])
            shared = int(differs[0]) if len(differs) else n
            last = 0
            while end[path[-1]] > shared:
                last = path.pop()
            if end[path[-1]] < shared:  # the edge to ``last`` forks inside
                parent.append(path[-1])
                start.append(end[path[-1]])
                end.append(shared)
                source.append(source[last])
                parent[last], start[last] = len(end) - 1, shared
                path.append(len(end) - 1)
            if len(s) > shared:
                parent.append(path[-1])
                start.append(shared)
                end.append(len(s))
                source.append(i)
                path.append(len(end) - 1)
            self.node_of[i] = path[-1]
            before = s
        self.lengths = np.array([len(s) for s in sets])
        order_nodes = np.argsort(start, kind="stable")  # parents before children
        self.parent, self.end = np.array(parent), np.array(end)
        size = np.array(end) - np.array(start)
        self.offset = np.cumsum(size) - size
        self.size = size
        self.tokens = np.concatenate([sequences[q][a:b] for q, a, b in zip(source, start, end, strict=True)])
        self.last = np.array([sequences[q][b - 1] if b else 0 for q, b in zip(source, end, strict=True)], np.uint64)
        level = np.zeros(len(end), np.int64)
        for k in order_nodes:
            if self.parent[k] >= 0:
                level[k] = level[self.parent[k]] + 1
        # The shortest and longest set at or below each node.
        self.least, self.most = np.full(len(end), 1 << 40), np.zeros(len(end), np.int64)
        np.minimum.at(self.least, self.node_of, self.lengths)
        np.maximum.at(self.most, self.node_of, self.lengths)
        for k in order_nodes[::-1]:
            up = self.parent[k]
            if up >= 0:
                self.least[up] = min(self.least[up], self.least[k])
                self.most[up] = max(self.most[up], self.most[k])
        self.levels = [np.flatnonzero(level == d) for d in range(1, int(level.max()) + 1)]

    def _enough(self, overlap: np.ndarray, mine: int, theirs: np.ndarray) -> np.ndarray:
        """overlap / union >= num / den, in whole numbers."""
        return (self.num + self.den) * overlap >= self.num * (mine + theirs)

    def linked(self, tokens: np.ndarray) -> np.ndarray:
        """Positions of the sets that link with ``tokens`` (sorted)."""
        overlap = np.full(len(self.end), -1, np.int64)
        overlap[0] = 0
        for nodes in self.levels:
            nodes = nodes[overlap[self.parent[nodes]] >= 0]
            if not len(nodes):
                break
            size = self.size[nodes]
            ends = np.cumsum(size)
            run = self.tokens[np.repeat(self.offset[nodes] - ends + size, size) + np.arange(ends[-1])]
            at = np.minimum(np.searchsorted(tokens, run), len(tokens) - 1)
            hits = np.concatenate([[0], np.cumsum(tokens[at] == run)])
            got = overlap[self.parent[nodes]] + hits[ends] - hits[ends - size]
            mine_left = np.searchsorted(tokens, self.last[nodes])
            best = np.clip(mine_left + self.end[nodes], self.least[nodes], self.most[nodes])
            reach = got + np.minimum(mine_left, best - self.end[nodes])
            overlap[nodes] = np.where(self._enough(reach, len(tokens), best), got, -1)
        mine = overlap[self.node_of]
        return np.flatnonzero((mine >= 0) & self._enough(mine, len(tokens), self.lengths))


def trie_index(num: int, den: int) -> links.Index:
    def make(payloads: Sequence[bytes]) -> Callable[[bytes], Sequence[int]]:
        trie = SetTrie([np.frombuffer(p, "<u8") for p in payloads], num, den)
        return lambda p: trie.linked(np.frombuffer(p, "<u8"))

    return make


def word_levels(texts: DataFrame) -> np.ndarray:
    """Twice the binary logarithm of each bucket's word count over all texts.

    Every task counts into a table of 2^``TABLE_BITS`` buckets; the tables are summed block
    by block, in two steps, and come to the driver as one table of that fixed size."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << TABLE_BITS, np.uint64)
        for part in parts(batches, 0):
            words, _ = word_hashes(part.column(0))
            at, times = np.unique(words >> np.uint64(64 - TABLE_BITS), return_counts=True)
            table[at] += times.astype(np.uint64)
        yield from table_rows(table, BLOCKS, PARTIAL_SUMS)

    def add(held: np.ndarray, more: np.ndarray) -> None:
        held += more

    width = (1 << TABLE_BITS) // BLOCKS
    counted = few_tasks(texts).mapInArrow(count, TABLE_COLUMNS)
    counts = np.zeros(1 << TABLE_BITS, np.uint64)
    for row in summed_tables(counted, "<u8", add).collect():  # BLOCKS rows
        counts[row["block"] * width : (row["block"] + 1) * width] = table_values(row["values"], "<u8")
    return np.minimum(np.round(2 * np.log2(counts + 1.0)), 127).astype(np.uint8)


def token_sets(texts: pa.Array, width: int, levels: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct tokens, sorted."""
    words, bounds = word_hashes(texts)
    of = levels[words >> np.uint64(64 - TABLE_BITS)].astype(np.int64)
    tokens, ends = shingle_hashes(words, bounds, width, of)
    return [np.unique(tokens[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def least_overlap(n: int, num: int, den: int) -> int:
    """The least overlap with any set at the threshold."""
    return -(-num * n // den)


def shared_at_least(n: int, num: int, den: int) -> int:
    """How many of their first tokens a set of ``n`` and a larger linked one share."""
    return min(max(SHARED_KEYS, -(-n // SHARED_PART)), least_overlap(n, num, den))


def first_tokens(n: int, num: int, den: int) -> int:
    """How many first tokens hold :func:`shared_at_least` of any overlap at the threshold."""
    return n - least_overlap(n, num, den) + shared_at_least(n, num, den)


def shared_needed(n: Column, num: int, den: int) -> Column:
    """How many first tokens of a set of ``n`` every linked set shares: what the smallest set
    that can link with it would."""
    smallest = F.ceil(n * num / F.lit(den))
    return F.least(F.greatest(F.lit(SHARED_KEYS), F.ceil(smallest / F.lit(SHARED_PART))), F.ceil(smallest * num / F.lit(den)))


def size_class(n: Column, num: int, den: int) -> Column:
    """Linked sets are in the same class or in adjacent ones (a little wider than need be,
    so that rounding cannot tell two apart)."""
    return F.floor(F.log(n.cast("double")) / F.lit(1.0001 * float(np.log(den / num))))


def _signatures(levels: Broadcast, width: int, num: int, den: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1):
            sets = token_sets(part.column(1), width, levels.value)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([s[: first_tokens(len(s), num, den)].view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "digest", "keys"],
            )

    return run


def _sets_in(levels: Broadcast, bitmap: Broadcast, width: int):
    """(id, tokens) of the documents that the filter lets pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1):
            ids = part.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            part = part.filter(pa.array(links.passes(bitmap.value, ids)))
            sets = token_sets(part.column(1), width, levels.value)
            payloads = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), payloads], names=["doc_id", "tokens"])

    return run


def _deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return links.deal_rows(
        row for batch in returning_memory(batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)
    )


def jaccard_components(
    docs: DataFrame,
    width: int = 5,
    num: int = 80,
    den: int = 100,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk_weight: int = links.CHUNK_WEIGHT,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest
    doc_id reachable by links of similarity ``num`` / ``den`` or more)."""
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    with arrow_rows(spark, links.TEXTS_AT_ONCE):
        levels = spark.sparkContext.broadcast(word_levels(raw.select("text")))
        signed = materialise(
            raw.mapInArrow(_signatures(levels, width, num, den), "doc_id long, n long, digest binary, keys array<long>")
        )
    known = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    distinct = known.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("weight"), F.first("keys").alias("keys"))
    records = distinct.select(F.explode("keys").alias("key"), "id", "weight")

    def with_sets(placed: DataFrame) -> DataFrame:
        bitmap = spark.sparkContext.broadcast(links.id_filter(placed.select("id")))
        sets = raw.where("doc_id IS NOT NULL").mapInArrow(_sets_in(levels, bitmap, width), "doc_id long, tokens binary")
        taken = sets.join(placed, sets["doc_id"] == placed["id"]).select("id", "tokens", "homes")
        return taken.mapInArrow(_deal, links.DEALT_COLUMNS)

    found = links.links(
        records,
        with_sets,
        trie_index(num, den),
        chunk_weight,
        needed=lambda n: shared_needed(n, num, den),
        length_class=lambda n: size_class(n, num, den),
    )
    # A copy is linked with its set's first document. Written first, the sets that have copies are
    # a plain side of the join, and AQE splits the other where a set has very many.
    of_digest = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    of_digest = materialise(of_digest.where("rows > 1").drop("rows"))
    copies = (
        known.select("doc_id", "digest")
        .join(of_digest, "digest")
        .where("doc_id <> first")
        .select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    )
    roots = connected_components(found.unionByName(copies))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(
        roots, F.col("doc_id") == F.col("id"), "left"
    )
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
