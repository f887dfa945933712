"""Packing in space-filling-curve order.

A document's token counts, hashed into 256 signed buckets and normalised, are projected to
three dimensions; the cell's place on a Hilbert curve is its key. Documents are
range-sorted by (key, doc_id), so neighbours in a sequence are alike, and each range is cut
into full sequences. What is left over at a range's end is cut at powers of two, so no
sequence needs padding.

Edge cases: a null or empty text is the end id alone; very long documents are cut over as
many sequences as they need; ties of the key (copies) go by doc_id, then by ids; repeated
rows are packed one by one; a null doc_id comes first. An empty table gives an empty result.
Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .tokens import Tokenizer, text_parts

BUCKETS = 256
DIMENSIONS = 3
BITS = 12
FLUSH_BYTES = 16 << 20


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (unsigned, below 2^bits).

    Skilling's transform (2004), over all rows at once: undo the curve's rotations from the
    highest bit down, Gray-code, and interleave the bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for i in range(dims):
            high = (x[i] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap if i else 0
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    twist = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        twist ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= twist
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> bit) & 1
    return key


class Projector:
    """Cells of documents from their token ids; fixed by ``seed`` alone."""

    def __init__(self, vocabulary: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.bucket = draw.integers(0, BUCKETS, vocabulary)
        self.sign = draw.choice([-1.0, 1.0], vocabulary)
        self.axes = draw.normal(size=(BUCKETS, DIMENSIONS))

    def vector(self, ids: np.ndarray) -> np.ndarray:
        counts = np.bincount(self.bucket[ids], weights=self.sign[ids], minlength=BUCKETS)
        length = np.sqrt(counts @ counts)
        return counts / length if length else counts

    def keys(self, vectors: list[np.ndarray]) -> np.ndarray:
        spread = np.tanh(np.asarray(vectors).reshape(-1, BUCKETS) @ self.axes)
        cells = np.clip(((spread + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        return hilbert_key(cells, BITS)


def _tokenise(path: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(path)
        end = end_id.to_bytes(tokenizer.dtype.itemsize, "little")
        project = Projector(max(tokenizer.library.get_vocab_size(), end_id + 1))
        for doc_ids, texts in text_parts(batches):
            ids, bounds = tokenizer.encode(texts)
            each = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            keys = project.keys([project.vector(x) for x in each])
            yield pa.RecordBatch.from_arrays(
                [doc_ids.cast(pa.int64()), pa.array(keys, pa.int64()), pa.array([x.tobytes() + end for x in each], pa.binary())],
                names=["doc_id", "key", "ids"],
            )

    return run


PIECES = "doc_id long, start long, doc_tokens long, sequence_id long, offset long, ids binary"


def powers_of_two(n: int) -> list[int]:
    """``n`` as a descending sum of distinct powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _pack(width: int, length: int):
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "start", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        done: list[tuple] = []
        held = 0
        #: Of the open sequence: doc_id, start, doc_tokens, ids.
        open_pieces: list[tuple] = []
        filled = 0

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence, held
            offset = 0
            for doc_id, start, total, ids in pieces:
                done.append((doc_id, start, total, sequence, offset, ids.astype("<u4").tobytes()))
                offset += len(ids)
            held += 4 * offset
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, coded in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(coded.as_py(), f"<u{width}")
                start = 0
                while start < len(ids):
                    piece = ids[start : start + length - filled]
                    open_pieces.append((doc_id, start, len(ids), piece))
                    start += len(piece)
                    filled += len(piece)
                    if filled == length:
                        close(open_pieces)
                        open_pieces, filled = [], 0
                        if held >= FLUSH_BYTES:
                            yield flush()
                            done, held = [], 0
        for part in powers_of_two(filled):
            taken: list[tuple] = []
            while part:
                doc_id, start, total, ids = open_pieces.pop(0)
                if len(ids) > part:
                    open_pieces.insert(0, (doc_id, start + part, total, ids[part:]))
                    ids = ids[:part]
                taken.append((doc_id, start, total, ids))
                part -= len(ids)
            close(taken)
        if done:
            yield flush()

    return run


def pack_along_curve(
    docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``doc_tokens``, ``sequence_id``, ``offset``
    and the piece's ``ids`` (little-endian unsigned 32-bit).

    Texts are tokenised once, into a scratch table; the range exchange samples the narrow
    key column of that table and moves ids, not text. A task streams its range, holding one
    open sequence. Sequence ids are gapless within a range only.
    """
    width = Tokenizer(tokenizer_path).dtype.itemsize
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    coded = materialise(raw.mapInArrow(_tokenise(tokenizer_path, end_id), "doc_id long, key long, ids binary"))
    ranged = coded.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return ranged.select("doc_id", "ids").mapInArrow(_pack(width, length), PIECES)
