"""Line deduplication by a segment-partition edit join.

Lines (between line breaks) are duplicates when equal, or when both have ``least_chars``
code points or more and their edit distance is at most the :func:`edits` that the shorter
one's length allows: ``threshold``, or, with ``chars_an_edit``, one for each so many code
points up to ``threshold``. A line is cut into one even segment more than its edits; a line
within them shares a segment unedited, near its place. So a line's keys are its own segments
and, for each length up to ``threshold`` shorter, the substrings that can be a line of that
length's segments (the multi-match-aware choice of Li et al. 2011). A line has some
``threshold`` ** 3 / 3 keys. Lines that share keys meet in the blocks of
:mod:`.links`, where the segments are looked up again and candidates are verified with a
banded bit-parallel edit distance. The classes are the connected components; the line
that comes first (doc_id, then line number) stays.

Edge cases: blank lines are never duplicates and stay; null texts have no lines; an empty
text has one blank line. A null doc_id comes first. Rows that repeat a doc_id count as one
document, the lines of which stay or go together. An empty table gives an empty result.
Only the id and text columns are read. Lines are equal when 128 bits of a cryptographic hash
agree. Half of these bits number the lines in the joins; different lines of one number (some
pairs among 10^10 lines) stay apart, and take no part in the edit join.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import links
from .common import arrow_rows, connected_components, materialise, returning_memory
from .words import mixed, parts, prefix_sums, substring_hashes

THRESHOLD = 2
LEAST_CHARS = 50
BLANK = b" \t\n\x0b\x0c\r"


def edits(length: int, threshold: int, chars_an_edit: int | None) -> int:
    """The edits that a line of ``length`` may be away."""
    return threshold if chars_an_edit is None else max(0, min(threshold, length // chars_an_edit))


def segments(length: int, count: int) -> list[tuple[int, int]]:
    """(start, size) of ``count`` even segments; the last ones take what is left over."""
    size, longer = divmod(length, count)
    out, at = [], 0
    for i in range(count):
        n = size + (i >= count - longer)
        out.append((at, n))
        at += n
    return out


def window(i: int, start: int, size: int, delta: int, threshold: int, length: int) -> range:
    """Where segment ``i`` (from 0) of a line ``delta`` shorter can begin in a line of ``length``."""
    low = max(0, start - i, start + delta - (threshold - i))
    high = min(length - size, start + i, start + delta + (threshold - i))
    return range(low, high + 1)


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most ``k``.

    Beyond the common beginning and end, a column of the distance table is kept as the
    vertical differences of the 2k + 1 rows around the diagonal, one bit a row, after
    Hyyrö (2003); the score follows the band's lower edge, then the last row."""
    if abs(len(a) - len(b)) > k:
        return False
    if len(a) > len(b):
        a, b = b, a
    skip = _common(a, b)
    a, b = a[skip:], b[skip:]
    tail = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    m, n = len(a), len(b)
    if n <= k:
        return True
    if not m:
        return False
    rows: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        rows[c] |= 1 << i
    band = (1 << (2 * k + 1)) - 1
    vp, vn = band >> k << k, 0
    score = min(k, m)  # the lowest row in the band, before the first column
    hopeless = 2 * k + n - m
    for j, c in enumerate(b, 1):
        eq = rows.get(c, 0)
        shift = j - k - 1
        eq = (eq >> shift if shift >= 0 else eq << -shift) & band
        diagonal = ((((eq & vp) + vp) ^ vp) | eq | vn) & band
        plus, minus = (vn | ~(diagonal | vp)) & band, diagonal & vp
        row = m - j + k  # the last row's bit
        if row >= 2 * k:
            score += not diagonal >> (2 * k) & 1
        else:
            score += (plus >> row & 1) - (minus >> row & 1)
        if score > hopeless:
            return False
        down = diagonal >> 1
        vp, vn = (minus | ~(down | plus)) & band, plus & down
    return score <= k


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high - 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class SegmentIndex:
    """Lines by (length, segment, text of the segment); those that allow no edit are left out."""

    def __init__(self, lines: Sequence[str], threshold: int, chars_an_edit: int | None = None):
        self.lines, self.threshold, self.chars_an_edit = lines, threshold, chars_an_edit
        self.edits = {n: edits(n, threshold, chars_an_edit) for n in {len(x) for x in lines}}
        self.places = defaultdict(list)
        for k, line in enumerate(lines):
            allowed = self.edits[len(line)]
            for i, (start, size) in enumerate(segments(len(line), allowed + 1) if allowed else ()):
                self.places[len(line), i, line[start : start + size]].append(k)

    def linked(self, line: str) -> list[int]:
        own = edits(len(line), self.threshold, self.chars_an_edit)
        out = []
        for length in range(len(line) - own, len(line) + own + 1):
            t = self.edits.get(length, 0)
            seen: set[int] = set()
            for i, (start, size) in enumerate(segments(length, t + 1) if t else ()):
                for at in window(i, start, size, len(line) - length, t, len(line)):
                    seen.update(self.places.get((length, i, line[at : at + size]), ()))
            out += [k for k in seen if within(line, self.lines[k], min(t, own))]
        return sorted(out)


def segment_index(threshold: int, chars_an_edit: int | None) -> links.Index:
    def make(payloads: Sequence[bytes]) -> Callable[[bytes], Sequence[int]]:
        found = SegmentIndex([p.decode() for p in payloads], threshold, chars_an_edit)
        return lambda p: found.linked(p.decode())

    return make


def split_lines(joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each line starts and ends (code points), and the code points."""
    data = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.flatnonzero(data == 10)
    return np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]]), data


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def line_digests(lines: Iterable[bytes]) -> np.ndarray:
    """Two numbers a line, of which the first is its id."""
    digests = b"".join(hashlib.blake2b(line, digest_size=16).digest() for line in lines)
    return np.frombuffer(digests, "<i8").reshape(-1, 2)


def _occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, 1):
        lines = [t.encode().split(b"\n") for t in _texts(part.column(1))]
        counts = [len(x) for x in lines]
        flat = [line for x in lines for line in x]
        blank = np.array([not line.strip(BLANK) for line in flat])
        digests = line_digests(flat)
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0).cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(lines)), counts))),
                pa.array(np.concatenate([np.arange(n) for n in counts]), pa.int32()),
                pa.array(digests[:, 0], pa.int64(), mask=blank),
                pa.array(digests[:, 1], pa.int64(), mask=blank),
            ],
            names=["doc_id", "line_no", "id", "check"],
        )


def long_lines(texts: list[str], least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of the distinct lines with ``least_chars`` or more: two numbers (:func:`line_digests`), where
    each starts and ends in the joined texts, these as code points, and the lines."""
    joined = "\n".join(texts)
    starts, ends, data = split_lines(joined)
    long = ends - starts >= least_chars
    distinct: dict[str, tuple[int, int]] = {}
    for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        distinct.setdefault(joined[a:b], (a, b))
    solid = {line: span for line, span in distinct.items() if line.strip(BLANK.decode())}
    lines = [line.encode() for line in solid]
    spans = np.array(list(solid.values()), np.int64).reshape(-1, 2)
    return line_digests(lines), spans[:, 0], spans[:, 1], data, lines


def _keys(threshold: int, least_chars: int, chars_an_edit: int | None):
    """(key, id, weight) of the distinct long lines of each part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1):
            digests, starts, ends, data, _ = long_lines(_texts(part.column(1)), least_chars)
            ids, length, sums = digests[:, 0], ends - starts, prefix_sums(data)
            keys, owners = [], []
            for delta in range(threshold + 1):
                allowed = np.full_like(length, threshold)
                if chars_an_edit is not None:
                    allowed = np.clip((length - delta) // chars_an_edit, 0, threshold)
                count = allowed + 1
                size, longer = np.divmod(length - delta, count)
                begin = np.zeros_like(length)
                for i in range(threshold + 1):
                    live = (allowed >= max(delta, 1)) & (i < count)
                    n = size + (i >= count - longer)
                    tags = mixed((length - delta).astype(np.uint64) * np.uint64(threshold + 1) + np.uint64(i))
                    # Of :func:`window`, what no line of the part can leave.
                    for step in range(max(-i, delta - (threshold - i)), min(i, delta + (threshold - i)) + 1):
                        at = begin + step
                        low = np.maximum(0, np.maximum(begin - i, begin + delta - (allowed - i)))
                        high = np.minimum(length - n, np.minimum(begin + i, begin + delta + (allowed - i)))
                        ok = live & (at >= low) & (at <= high)
                        if ok.any():
                            a = starts[ok] + at[ok]
                            keys.append(mixed(substring_hashes(sums, a, a + n[ok]) ^ tags[ok]))
                            owners.append(np.flatnonzero(ok))
                    begin = begin + n
            if owners:
                owner = np.concatenate(owners)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(ids[owner]),
                        pa.array(length[owner].astype(np.int64)),
                    ],
                    names=["key", "id", "weight"],
                )

    return run


def _lines_in(bitmap: Broadcast, least_chars: int):
    """(id, check, line) of the distinct long lines of each part that the filter lets pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1):
            digests, _, _, _, lines = long_lines(_texts(part.column(1)), least_chars)
            passed = np.flatnonzero(links.passes(bitmap.value, digests[:, 0]))
            columns = [pa.array(digests[passed, 0]), pa.array(digests[passed, 1]), pa.array([lines[k] for k in passed], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "check", "line"])

    return run


def _deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return links.deal_rows(
        (i, line, homes)
        for batch in returning_memory(batches)
        for i, line, homes in zip(*(c.to_pylist() for c in batch.columns), strict=True)
    )


def line_classes(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    least_chars: int = LEAST_CHARS,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk_weight: int = links.CHUNK_WEIGHT,
    chars_an_edit: int | None = None,
) -> DataFrame:
    """One row per line: ``doc_id``, ``line_no`` (from 0), ``keep_doc_id`` and ``keep_line_no``
    (of the line that stays for its class), ``class_size`` (lines in the class), ``kept``.

    Blank lines are classes of their own.
    """
    if chars_an_edit is not None and chars_an_edit < 3:
        raise ValueError("chars_an_edit must be 3 or more, for segments of a character or more")
    if chars_an_edit is None and least_chars <= 2 * threshold:
        raise ValueError("least_chars must exceed twice the threshold, for segments of a character or more")
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    with arrow_rows(docs.sparkSession, links.TEXTS_AT_ONCE):
        lines = materialise(raw.mapInArrow(_occurrences, "doc_id long, line_no int, id long, check long"))
    records = raw.mapInArrow(_keys(threshold, least_chars, chars_an_edit), "key long, id long, weight long")

    def with_lines(placed: DataFrame) -> DataFrame:
        bitmap = docs.sparkSession.sparkContext.broadcast(links.id_filter(placed.select("id")))
        found = raw.mapInArrow(_lines_in(bitmap, least_chars), "id long, check long, line binary")
        each = placed.join(found, "id").groupBy("id").agg(
            F.first("line").alias("line"),
            F.first("homes").alias("homes"),
            F.min("check").alias("least"),
            F.max("check").alias("most"),
        )
        return each.where("least = most").select("id", "line", "homes").mapInArrow(_deal, links.DEALT_COLUMNS)

    roots = connected_components(links.links(records, with_lines, segment_index(threshold, chars_an_edit), chunk_weight))
    solid = lines.where("id IS NOT NULL")
    firsts = solid.groupBy("id", "check").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    linked = materialise(firsts.join(roots, "id"))
    of_class = linked.groupBy("root").agg(F.min("first").alias("class_first"), F.sum("n").alias("class_n"))
    known = linked.select("id", "root").join(of_class, "root").drop("root")
    classes = materialise(
        firsts.join(known, "id", "left").select(
            "id", "check", F.coalesce("class_first", "first").alias("first"), F.coalesce("class_n", "n").alias("class_size")
        )
    )
    out = solid.join(classes, ["id", "check"]).select(
        "doc_id",
        "line_no",
        F.col("first.doc_id").alias("keep_doc_id"),
        F.col("first.line_no").alias("keep_line_no"),
        "class_size",
    )
    blank = lines.where("id IS NULL").select(
        "doc_id",
        "line_no",
        F.col("doc_id").alias("keep_doc_id"),
        F.col("line_no").alias("keep_line_no"),
        F.lit(1).cast("long").alias("class_size"),
    )
    stays = F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("line_no") == F.col("keep_line_no"))
    return out.unionByName(blank).withColumn("kept", stays)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text``; documents that lose all their
    lines but blank ones are dropped, others stay, with all their columns."""
    classes = line_classes(docs, doc_id=doc_id, text=text, **options)
    gone = (
        classes.where(~F.col("kept"))
        .groupBy(F.col("doc_id").alias("__doc_id"))
        .agg(F.collect_set("line_no").alias("__gone"))
    )
    joined = docs.join(gone, docs[doc_id].eqNullSafe(gone["__doc_id"]), "left")
    # The lines are made once, behind a generator, for the look-ups by number; the numbers that
    # stay come from a hash set. So the work on a text grows with its lines, not their square.
    lines = F.when(F.col("__gone").isNotNull(), F.split(F.col(text), "\n"))
    joined = joined.select("*", F.explode(F.array(lines)).alias("__lines"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    rest = F.array_join(F.transform(stays, lambda i: F.get("__lines", i)), "\n")
    joined = joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(rest))
    empty = F.col("__gone").isNotNull() & (F.length(F.translate(F.col(text), " \t\n\x0b\x0c\r", "")) == 0)
    return joined.where(~empty).select(docs.columns)
