"""Words and word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import returning_memory

#: Bytes of text whose words are hashed at a time (a longer text makes a part of its own).
PART_BYTES = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
#: Odd multipliers of a shingle's first, second, ... word.
PLACES = [pow(0xD1342543DE82EF95, i + 1, 1 << 64) | 1 for i in range(16)]
ONE = np.uint64(1)
#: Words of more bytes get a cryptographic hash: strings can be made whose polynomials modulo
#: 2^64 agree, but they are long.
POLYNOMIAL_BYTES = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of ``BASE`` and of its inverse modulo 2^64, as far as texts have needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            step, back = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step), np.cumprod(back)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums from which any substring's hash follows (:meth:`of`)."""
        self.reach(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + ONE) * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the substrings; equal for equal bytes, wherever they stand."""
        return mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * ~ONE)


POWERS = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    return POWERS.sums(data)


def substring_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return POWERS.of(sums, starts, ends)


def digest64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def parts(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column``'s texts have about ``PART_BYTES``."""
    for batch in returning_memory(batches):
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.cumsum(sizes) // PART_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, bounds); null texts are empty."""
    whole = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    bounds = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if len(whole) else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, bounds by text).

    Words are what lies between the ASCII white space characters; A-Z count as a-z."""
    data, bounds = text_bytes(texts)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = (data != 32) & ((data < 9) | (data > 13))
    before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
    begins = bounds[:-1][bounds[:-1] < len(data)]
    before[begins] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
    after[begins[begins > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    hashes = substring_hashes(prefix_sums(low), starts, ends)
    for k in np.flatnonzero(ends - starts > POLYNOMIAL_BYTES):
        hashes[k] = digest64(low[starts[k] : ends[k]].tobytes())
    return hashes, np.searchsorted(starts, bounds)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of the shingles of all texts, bounds by text).

    A text's shingles are its runs of ``width`` words; with fewer words, all of them as one;
    without words, none. A token's first byte is the mean of ``levels`` over its words,
    doubled, the rest its hash."""
    counts = np.diff(bounds)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.cumsum(made)
    starts = np.repeat(bounds[:-1] - (ends - made), made) + np.arange(ends[-1] if len(ends) else 0)
    size = np.repeat(np.minimum(counts, width), made)
    summed, level = size.astype(np.uint64), np.zeros(len(starts), np.int64)
    for i in range(width):
        inside = i < size
        at = np.where(inside, starts + i, 0)
        if len(at):
            summed = summed + np.where(inside, words[at] * np.uint64(PLACES[i]), np.uint64(0))
            level += np.where(inside, levels[at], 0)
    first = np.minimum(2 * level // np.maximum(size, 1), 255).astype(np.uint64)
    return first << np.uint64(56) | mixed(summed) >> np.uint64(8), np.concatenate([[0], ends])
