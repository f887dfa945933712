"""Best-fit-decreasing packing into fixed-width rows of token ids.

Documents longer than a row are split losslessly into full rows and a rest. The pieces of
a window of documents are placed longest first, each into the open row with the least room
that still holds it; a segment tree over capacities finds that row in logarithmic time.
There is no shuffle: each task packs its own part of the scan, window by window.

Edge cases: a null or empty text is the end id alone; repeated rows are packed one by one;
ties in length go by the order read. An empty table gives an empty result. Only the id and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Tokenizer, text_parts

#: A window closes at so many pieces or tokens.
WINDOW_PIECES = 8192
WINDOW_TOKENS = 4 << 20
FLUSH_ROWS = 512


class Capacities:
    """Open rows by free capacity: a segment tree whose leaves count rows of a capacity."""

    def __init__(self, largest: int):
        self.size = 1 << largest.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(largest + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = capacity + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take_best(self, need: int) -> tuple[int, int] | None:
        """Removes and gives (capacity, row) of the smallest capacity of at least ``need``."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (not self.count[2 * node])
        capacity = node - self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers, each row's lengths summing to ``width`` at most."""
    rows: list[list[int]] = []
    free = Capacities(width)
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take_best(lengths[piece])
        capacity, row = found if found else (width, len(rows))
        if not found:
            rows.append([])
        rows[row].append(piece)
        if capacity > lengths[piece]:
            free.add(capacity - lengths[piece], row)
    return rows


SCHEMA = pa.schema(
    [
        ("sequence_id", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("input_ids", pa.binary()),
        ("position_ids", pa.binary()),
        ("n_tokens", pa.int32()),
    ]
)
COLUMNS = (
    "sequence_id long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, "
    "input_ids binary, position_ids binary, n_tokens int"
)


def _pack(path: str, width: int, end_id: int, pad_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(path)
        sequence = TaskContext.get().partitionId() << 32
        pieces: list[tuple] = []
        tokens = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out: list[tuple] = []
            for row in best_fit_decreasing([len(p[2]) for p in pieces], width):
                ids = np.full(width, pad_id, "<u4")
                positions = np.zeros(width, "<u4")
                bounds = [0]
                for i in row:
                    piece = pieces[i][2]
                    at = bounds[-1]
                    ids[at : at + len(piece)] = piece
                    positions[at : at + len(piece)] = np.arange(len(piece))
                    bounds.append(at + len(piece))
                out.append(
                    (
                        sequence,
                        [pieces[i][0] for i in row],
                        [pieces[i][1] for i in row],
                        bounds,
                        ids.tobytes(),
                        positions.tobytes(),
                        bounds[-1],
                    )
                )
                sequence += 1
                if len(out) == FLUSH_ROWS:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

        for doc_ids, texts in text_parts(batches):
            ids, bounds = tokenizer.encode(texts)
            for doc_id, a, b in zip(doc_ids.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                whole = np.append(ids[a:b], tokenizer.dtype.type(end_id))
                for start in range(0, len(whole), width):
                    pieces.append((doc_id, start, whole[start : start + width]))
                tokens += len(whole)
                if len(pieces) >= WINDOW_PIECES or tokens >= WINDOW_TOKENS:
                    yield from packed()
                    pieces, tokens = [], 0
        yield from packed()

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def pack_best_fit(
    docs: DataFrame,
    tokenizer_path: str,
    width: int = 2048,
    end_id: int = 1,
    pad_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per sequence of ``width`` ids: ``doc_ids`` and ``starts`` of its segments,
    ``cu_seqlens`` (cumulative lengths, from 0), ``input_ids`` and ``position_ids``
    (``width`` little-endian unsigned 32-bit numbers; positions restart at each segment,
    and a segment's place in its document is in ``starts``), ``n_tokens`` before padding.
    """
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return raw.mapInArrow(_pack(tokenizer_path, width, end_id, pad_id), COLUMNS)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet: rows of the id matrix with their segment bounds."""
    packed.write.parquet(path)
