"""Linking records that share keys, without emitting the pairs of a key's group.

A similarity join's filter gives each record some keys, so that every two records that may
link share a key, or several: a record with fewer shared keys than its links would have is
left out. The records of a key form a block under the key's hub, its smallest id: all keys
with the same hub make one block, into which a record goes once. Where records can only
link within a length class or with the next one, a block is parted by these classes. A task
links the records of a block and gives a spanning forest of the links found.

A block above ``chunk_weight`` is dealt into chunks, each with the block's center (its
smallest id) in it. Records that their chunk links with the center are in one component
already; only the others (leftovers) are then compared with all other chunks. So a large
group of near copies costs about one comparison a record, and no link between records of
different components is lost. Leftovers visit a chunk in slices of bounded weight, each a
task's own, and pass by the chunk's rows one after another: a task holds one chunk and a
batch, however many leftovers there are. Their comparisons still grow with the square of a
block whose records share a key but do not link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import TABLE_COLUMNS, arrow_rows, few_tasks, materialise, returning_memory, summed_tables, table_rows, table_values

CHUNK_WEIGHT = 1 << 18
#: The filter that tells which ids are in blocks: a bitmap of this fixed size.
FILTER_BITS = 24
FILTER_MASK = (1 << FILTER_BITS) - 1
FILTER_BLOCKS = 16
PARTIAL_SUMS = 16
FLUSH_BYTES = 8 << 20
#: Chunks' weights of leftovers in a slice.
SLICE_CHUNKS = 8

#: Rows of payloads that a task takes at a time.
ROWS_AT_ONCE = 400
#: Texts that a task takes at a time.
TEXTS_AT_ONCE = 2000

#: Finds the linked records of a block: built from the payloads, called with a payload, it
#: returns the positions of those that link with it.
Index = Callable[[Sequence[bytes]], Callable[[bytes], Sequence[int]]]


def hub_members(records: DataFrame, needed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(hub, id, weight) from (key, id, weight): each record once per hub of its keys; records
    of one id but of several weights once for each weight, as each may link in its own class.

    ``needed`` tells from the weight how many shared keys a record must have to link."""
    groups = records.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"))
    # One row a key, and fewer keys than records: hashed in each task, the records need no sort.
    shared = groups.where("hub < last").select("key", "hub").hint("shuffle_hash")
    members = (
        records.join(shared, "key")
        .groupBy("hub", "id", "weight")
        .agg(F.count(F.lit(1)).alias("keys"))
    )
    if needed is not None:
        # Linked records share the needed keys over the hubs that they have in common, so under
        # one of these hubs at least the needed number by the hubs of either. Elsewhere, and with
        # too few keys in all, a record meets nothing it links with that it does not meet there.
        # (A record has few hubs: no more than keys.)
        of_id = Window.partitionBy("id")
        least = needed(F.col("weight"))
        members = (
            members.withColumn("all_keys", F.sum("keys").over(of_id))
            .withColumn("hubs", F.count(F.lit(1)).over(of_id))
            .where((F.col("all_keys") >= least) & (F.col("keys") * F.col("hubs") >= least))
        )
    return members.select("hub", "id", "weight")


def homes(
    members: DataFrame, chunk_weight: int, length_class: Callable[[Column], Column] | None = None
) -> DataFrame:
    """(id, homes) from (hub, id, weight): the chunks (block, chunk, chunks, center) it goes to.

    With classes, a record goes to its hub's block of its own class and of the next, unless
    there is no record of that class to meet."""
    if length_class is None:
        parted = members.select(F.col("hub").alias("block"), "id", "weight", F.lit(1).alias("own"))
    else:
        own = length_class(F.col("weight")).cast("long")
        both = members.withColumn("class", F.explode(F.array(own, own + 1)))
        parted = both.select(
            F.xxhash64("hub", "class").alias("block"),
            "id",
            "weight",
            (F.col("class") == own).cast("int").alias("own"),
        )
    blocks = (
        parted.groupBy("block")
        .agg(
            F.min("id").alias("center"),
            F.count(F.lit(1)).alias("records"),
            F.max("own").alias("met"),
            F.ceil(F.sum("weight") / F.lit(chunk_weight)).cast("int").alias("chunks"),
        )
        .where("records > 1 AND met = 1")
        .select("block", "center", "chunks")
    )
    dealt = parted.join(blocks, "block")
    one = F.array(F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    placed = dealt.withColumn("chunk", F.explode(F.when(F.col("id") == F.col("center"), every).otherwise(one)))
    return placed.groupBy("id").agg(F.collect_list(F.struct("block", "chunk", "chunks", "center")).alias("homes"))


class Components:
    """Union-find over positions, labels kept flat for numpy."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x == y:
            return False
        self.label[self.label == y] = x
        return True


def link_block(payloads: Sequence[bytes], index: Index) -> tuple[list[tuple[int, int]], Components]:
    """Spanning links between the positions of one block, and their components.

    A pair needs no look once both are in one component, so records are looked up until
    those not looked up yet all are in one: first the hub, then from the smallest rest."""
    find = index(payloads)
    parts, links = Components(len(payloads)), []
    waiting = np.ones(len(payloads), bool)
    at = 0
    while True:
        waiting[at] = False
        for other in find(payloads[at]):
            if parts.join(at, int(other)):
                links.append((at, int(other)))
        sizes = np.bincount(parts.label[waiting], minlength=1)
        left = np.flatnonzero(sizes)
        if len(left) < 2:
            return links, parts
        smallest = left[sizes[left].argmin()]
        at = int(np.flatnonzero(waiting & (parts.label == smallest))[0])


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of sorted batches, grouped by the first two columns."""
    rows: list[tuple] = []
    for batch in returning_memory(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:2] != rows[0][:2]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of the ids' last bits: of fixed size, made in the tasks and united in two steps.

    On very many ids it lets every record pass; it only saves moving payloads that no block
    needs."""
    width = (1 << FILTER_BITS) // 8 // FILTER_BLOCKS

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False) & FILTER_MASK
            np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield from table_rows(packed, FILTER_BLOCKS, PARTIAL_SUMS)

    def unite(held: np.ndarray, more: np.ndarray) -> None:
        held |= more

    marked = few_tasks(ids).mapInArrow(mark, TABLE_COLUMNS)
    out = np.zeros((FILTER_BLOCKS, width), np.uint8)
    for row in summed_tables(marked, "u1", unite).collect():  # FILTER_BLOCKS rows
        out[row["block"]] = table_values(row["values"], "u1")
    return out.ravel()


def passes(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids :func:`id_filter`'s bitmap lets pass."""
    at = ids & FILTER_MASK
    return (bitmap[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


LINKS = pa.schema([("block", pa.int64()), ("chunk", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _flush(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), LINKS, strict=True)], schema=LINKS
    )


def _link_chunks(index: Index):
    """(block, chunk, a, b): links a-b, and leftovers a with a null b."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _groups(batches):
            block, chunk, chunks, center = rows[0][:4]
            rows.sort(key=lambda r: r[4] != center)
            links, parts = link_block([r[5] for r in rows], index)
            out += [(block, chunk, rows[i][4], rows[j][4]) for i, j in links]
            if chunks > 1:
                out += [(block, chunk, rows[i][4], None) for i in np.flatnonzero(parts.label != parts.label[0])]
            if len(out) > 50_000:
                yield _flush(out)
                out = []
        if out:
            yield _flush(out)

    return run


def _link_leftovers(index: Index):
    """Links between a chunk and leftovers of other chunks, one for each component of it.

    A chunk's own rows come before its guests, which are not kept."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        place, own, payloads, find, parts = None, [], [], None, None
        for batch in returning_memory(batches):
            for block, chunk, _, _, i, payload, probe, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, chunk, part) != place:
                    place, own, payloads, find = (block, chunk, part), [], [], None
                if not probe:
                    own.append(i)
                    payloads.append(payload)
                elif own:
                    if find is None:
                        _, parts = link_block(payloads, index)
                        find = index(payloads)
                    one = {int(parts.label[k]): k for k in find(payload)}
                    out += [(block, chunk, i, own[k]) for k in one.values()]
            if len(out) > 50_000:
                yield _flush(out)
                out = []
        if out:
            yield _flush(out)

    return run


DEALT = pa.schema(
    [
        ("block", pa.int64()),
        ("chunk", pa.int32()),
        ("chunks", pa.int32()),
        ("center", pa.int64()),
        ("id", pa.int64()),
        ("payload", pa.binary()),
        ("probe", pa.bool_()),
        ("slice", pa.int32()),
    ]
)
DEALT_COLUMNS = "block long, chunk int, chunks int, center long, id long, payload binary, probe boolean, slice int"
LINK_COLUMNS = "block long, chunk int, a long, b long"


def _spots(home: dict) -> Iterator[tuple[int, int]]:
    """(chunk, slice) of a home. A guest goes to its slice of all chunks but its own, a
    chunk's own record to all slices of it."""
    if home.get("probe"):
        return ((c, home["slice"]) for c in range(home["chunks"]) if c != home["chunk"])
    return ((home["chunk"], k) for k in range(home.get("slices", 1)))


def deal_rows(rows: Iterable[tuple[int, bytes, list[dict]]]) -> Iterator[pa.RecordBatch]:
    """Batches of ``DEALT`` from (id, payload, homes); for the operators' own tasks.

    A home may name ``probe``: then the record is a guest of the block's other chunks."""
    out: list[tuple] = []
    held = 0
    for i, payload, places in rows:
        for h in places:
            for chunk, part in _spots(h):
                out.append((h["block"], chunk, h["chunks"], h["center"], i, payload, h.get("probe", False), part))
                held += len(payload) + 64
                if held >= FLUSH_BYTES:
                    yield _dealt(out)
                    out, held = [], 0
    if out:
        yield _dealt(out)


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DEALT, strict=True)], schema=DEALT
    )


def _by_chunk(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("block", "chunk", "slice").sortWithinPartitions("block", "chunk", "slice", "probe", "id")


def links(
    records: DataFrame,
    with_payloads: Callable[[DataFrame], DataFrame],
    index: Index,
    chunk_weight: int = CHUNK_WEIGHT,
    needed: Callable[[Column], Column] | None = None,
    length_class: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(a, b): a spanning forest of all links, from (key, id, weight) records.

    ``with_payloads`` takes (id, homes) and returns the ``DEALT`` rows of those ids."""
    spark = records.sparkSession
    with arrow_rows(spark, TEXTS_AT_ONCE):
        members = materialise(hub_members(records, needed))
    placed = materialise(homes(members, chunk_weight, length_class))
    with arrow_rows(spark, ROWS_AT_ONCE):
        found = materialise(_by_chunk(with_payloads(placed)).mapInArrow(_link_chunks(index), LINK_COLUMNS))
    edges = found.where("b IS NOT NULL").select("a", "b")
    left = found.where("b IS NULL").select("block", F.col("chunk").alias("home"), F.col("a").alias("id"))
    if left.isEmpty():
        return edges
    split = placed.select("id", F.explode("homes").alias("h")).where("h.chunks > 1").select("id", "h.*")
    width = split.groupBy("block").agg(
        F.max("chunks").alias("chunks"), F.max("center").alias("center"), F.count(F.lit(1)).alias("records")
    )
    slices = F.ceil(F.col("leftovers") * F.col("chunks") / (F.col("records") * F.lit(SLICE_CHUNKS))).cast("int")
    visited = materialise(
        left.groupBy("block")
        .agg(F.count(F.lit(1)).alias("leftovers"))
        .join(width, "block")
        .select("block", "chunks", "center", slices.alias("slices"))
    )
    home = ("block", "chunk", "chunks", "center", "probe", "slice", "slices")
    guests = (
        left.withColumnRenamed("home", "chunk")
        .join(visited, "block")
        .withColumn("probe", F.lit(True))
        .withColumn("slice", F.pmod(F.xxhash64("id", "block"), F.col("slices")).cast("int"))
        .select("id", *home)
    )
    hosts = (
        split.join(visited.select("block", "slices"), "block")
        .withColumn("probe", F.lit(False))
        .withColumn("slice", F.lit(0))
        .select("id", *home)
    )
    again = hosts.unionByName(guests).groupBy("id").agg(F.collect_list(F.struct(*home)).alias("homes"))
    again = materialise(again)
    with arrow_rows(spark, ROWS_AT_ONCE):
        across = _by_chunk(with_payloads(again)).mapInArrow(_link_leftovers(index), LINK_COLUMNS)
        return edges.unionByName(materialise(across.select("a", "b")))
