"""Exact top-k inner products of whole-number vectors, in the order of descending length.

A vector's components are taken as ``floor(scale * x)``. Vectors are sorted by length by
range and cut into slabs (one row each), queries into blocks (one row each). A task takes one
block through a run of slabs, longest vectors first, and keeps each query's best ``k`` so far;
the k-th of them is the query's threshold. Against a slab a query drops out when its length
times the slab's longest is under the threshold. For the others the vectors are turned by the
singular vectors of a sample, which puts most of their length into the first coordinates: the
inner product over these plus the product of the lengths that remain (Cauchy-Schwarz) bounds
the whole; pairs whose bound is under the threshold are left, and the rest gets more
coordinates, then the exact product of the whole numbers. Turning is only for the bounds,
which allow for rounding, so any sample gives exact results.

The thresholds start from the first slab: all blocks meet it before the others. A block
meets a slab in one task only, and only if some query's threshold is within reach of the
slab's longest vector; the rows that leave a task are ``k`` a query. The products still grow
with queries times vectors where lengths are alike, as any exact search's do in the worst case.

Edge cases: a vector that is null or holds a null or a number that is not finite takes no
part, nor does a row without a vec_id, nor one whose squared whole-number length is 2^62 or
more (its products may not fit 64 bits). Shorter vectors count as if zeros followed; an empty
one has the product 0 with all. Rows that repeat a vec_id are vectors of their own: a query
leaves out only its own row. Equal scores stand by ascending vec_id. With ``k`` or fewer
candidates all are returned. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drawn, materialise

K = 20
SCALE = 64
QUERY_EVERY = 20
#: Vectors in a slab, and the most queries in a block.
SLAB_ROWS = 1024
BLOCK_QUERIES = 2048
#: Blocks have so many queries at least, unless the block is the only one.
LEAST_QUERIES = 256
#: A task takes a block through the slabs of a run: about so many, more where that would be
#: more than ``RUNS`` runs, since each run gives ``k`` rows a query.
RUN_SLABS = 32
RUNS = 64
#: Rows that the rotation is fitted on.
SAMPLE_ROWS = 4096
#: Shares of the sample's squared length that the coordinates of a partial sum hold.
SHARES = (0.5, 0.8)
#: Pairs whose whole products are made at a time.
PAIRS_AT_ONCE = 1 << 16
#: Products under this are exact in doubles.
EXACT = float(1 << 53)
#: Rounding that the bounds allow for, as a share of the lengths' product.
ROUNDING = 1e-9

SLAB = "rows binary, ids binary, whole binary, longest double"
BLOCK = "block long, rows binary, ids binary, whole binary"


def whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, whole array<long>, square double) of the rows that take part."""

    def whole(x: Column) -> Column:  # beyond 64 bits it stops at their ends, and the row is left out
        return F.floor(F.lit(float(scale)) * x.cast("double"))

    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(whole(x).cast("double"), F.lit(2.0)))
    parts = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(fine).withColumn("square", square)
    return parts.where(F.col("square") < float(1 << 62)).select("row", "vec_id", F.transform("embedding", whole).alias("whole"), "square")


def fit_rotation(vectors: DataFrame, count: int, width: int, sample_rows: int) -> tuple[np.ndarray, list[int]]:
    """The right singular vectors, strongest first, of at most ``sample_rows`` vectors, and how
    many coordinates each partial sum takes."""
    few = vectors.where(drawn(F.col("row")) < F.lit(2.0 * sample_rows / max(count, 1) * 2**52))
    sample = np.zeros((width, width))  # rows of zeros add nothing
    taken = [r["whole"] for r in few.select("whole").limit(sample_rows).collect()]
    if taken:
        sample = np.concatenate([sample, np.array([[*v, *[0] * (width - len(v))] for v in taken], float)])
    _, strength, rotation = np.linalg.svd(sample, full_matrices=False)
    energy = np.cumsum(strength**2)
    cuts = sorted({int(np.searchsorted(energy, s * energy[-1])) + 1 for s in SHARES}) if energy[-1] else []
    return rotation, [c for c in cuts if c < width]


def packed(part: pa.Table, width: int) -> tuple[bytes, bytes, bytes, float]:
    lists = part.column("whole").combine_chunks()
    inside = np.arange(width) < lists.value_lengths().to_numpy(zero_copy_only=False)[:, None]
    whole = np.zeros((len(lists), width), "<i8")
    whole[inside] = lists.flatten().to_numpy(zero_copy_only=False)
    row, vec_id = (part.column(c).to_numpy().astype("<i8") for c in ("row", "vec_id"))
    return row.tobytes(), vec_id.tobytes(), whole.tobytes(), float(np.sqrt(part.column("square").to_numpy().max()))


def _slabs(width: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sized(batches, rows):
            columns = [pa.array([x]) for x in packed(part, width)]
            yield pa.RecordBatch.from_arrays(columns, names=["rows", "ids", "whole", "longest"])

    return run


def _block(width: int):
    def run(part: pa.Table) -> pa.Table:
        columns = [part.column("block")[:1].combine_chunks(), *(pa.array([x]) for x in packed(part, width)[:3])]
        return pa.Table.from_arrays(columns, names=["block", "rows", "ids", "whole"])

    return run


def _sized(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows as they come, ``rows`` at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while len(batch):
            room = rows - sum(map(len, held))
            held.append(batch.slice(0, room))
            batch = batch.slice(room)
            if sum(map(len, held)) == rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


class Vectors:
    """Whole-number vectors with their turned coordinates and what remains after each cut."""

    def __init__(self, rows: bytes, ids: bytes, whole: bytes, rotation: np.ndarray, cuts: list[int]):
        self.rows, self.ids = np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8")
        self.whole = np.frombuffer(whole, "<i8").reshape(len(self.rows), len(rotation))
        self.floats = self.whole.astype(float)
        self.lengths = np.sqrt((self.floats * self.floats).sum(axis=1))
        turned = self.floats @ rotation.T
        self.parts = [turned[:, a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        self.left = [np.sqrt((turned[:, c:] ** 2).sum(axis=1)) for c in cuts]


class Nearest:
    """A block of queries with the best of the vectors seen so far."""

    def __init__(self, queries: Vectors, k: int, floors: np.ndarray | None = None):
        self.queries, self.k = queries, k
        self.floors = np.full(len(queries.rows), -np.inf) if floors is None else floors.copy()
        self.of = self.ids = self.scores = np.zeros(0, np.int64)
        self.exact_pairs = 0

    def meet(self, slab: Vectors) -> None:
        q = self.queries
        longest = slab.lengths.max(initial=0.0)
        active = np.flatnonzero(q.lengths * longest * (1 + ROUNDING) >= self.floors)
        if not len(active):
            return
        a, b = self._candidates(active, slab)
        self.exact_pairs += len(a)
        of, ids, scores = [self.of], [self.ids], [self.scores]
        every = None
        if len(a) > len(active) * len(slab.rows) // 8 and q.lengths.max() * longest < EXACT:
            every = (q.floats[active] @ slab.floats.T).astype(np.int64)
            row_of = np.searchsorted(active, a)
        for at in range(0, len(a), PAIRS_AT_ONCE):
            qa, vb = a[at : at + PAIRS_AT_ONCE], b[at : at + PAIRS_AT_ONCE]
            if every is None:
                score = np.einsum("ij,ij->i", q.whole[qa], slab.whole[vb])
            else:
                score = every[row_of[at : at + PAIRS_AT_ONCE], vb]
            kept = (score >= self.floors[qa]) & (q.rows[qa] != slab.rows[vb])
            of.append(qa[kept])
            ids.append(slab.ids[vb[kept]])
            scores.append(score[kept])
        self._keep(np.concatenate(of), np.concatenate(ids), np.concatenate(scores))

    def _candidates(self, active: np.ndarray, slab: Vectors) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) whose bound reaches the query's threshold."""
        q = self.queries
        slack = ROUNDING * q.lengths[active] * slab.lengths.max(initial=0.0)
        floors = self.floors[active] - slack
        if not q.parts:
            a, b = np.divmod(np.arange(len(active) * len(slab.rows)), max(1, len(slab.rows)))
            return active[a], b
        partial = q.parts[0][active] @ slab.parts[0].T
        a, b = np.nonzero(partial + np.outer(q.left[0][active], slab.left[0]) >= floors[:, None])
        for part_q, part_v, left_q, left_v in zip(q.parts[1:], slab.parts[1:], q.left[1:], slab.left[1:], strict=True):
            if len(a) > partial.size // 8:
                partial += part_q[active] @ part_v.T
                a, b = np.nonzero(partial + np.outer(left_q[active], left_v) >= floors[:, None])
            else:
                kept = []
                for at in range(0, len(a), PAIRS_AT_ONCE):
                    i, j = a[at : at + PAIRS_AT_ONCE], b[at : at + PAIRS_AT_ONCE]
                    partial[i, j] += np.einsum("ij,ij->i", part_q[active[i]], part_v[j])
                    kept.append(partial[i, j] + left_q[active[i]] * left_v[j] >= floors[i])
                kept = np.concatenate([np.zeros(0, bool), *kept])
                a, b = a[kept], b[kept]
        return active[a], b

    def _keep(self, of: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((ids, -scores, of))
        of, ids, scores = of[order], ids[order], scores[order]
        first = np.searchsorted(of, of)
        kept = np.arange(len(of)) - first < self.k
        self.of, self.ids, self.scores = of[kept], ids[kept], scores[kept]
        last = np.flatnonzero((np.arange(len(of)) - first) == self.k - 1)
        self.floors[of[last]] = np.maximum(self.floors[of[last]], scores[last])

    def found(self) -> pa.RecordBatch:
        columns = [self.queries.rows[self.of], self.queries.ids[self.of], self.ids, self.scores]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "vec_id", "score"])


FOUND = "query long, query_id long, vec_id long, score long"


def _first(head: Broadcast, rotation: Broadcast, cuts: list[int], k: int):
    """Each block with its queries' thresholds from one slab, and how long a vector must be at
    least to reach the threshold of any of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab = Vectors(*head.value, rotation.value, cuts)
        for batch in batches:
            for r in batch.to_pylist():
                near = Nearest(Vectors(r["rows"], r["ids"], r["whole"], rotation.value, cuts), k)
                near.meet(slab)
                lengths = np.maximum(near.queries.lengths, 1e-300) * (1 + ROUNDING)
                reach = np.where(near.floors <= 0, 0.0, near.floors / lengths).min()
                yield pa.RecordBatch.from_pylist([r | {"floors": near.floors.astype("<f8").tobytes(), "reach": float(reach)}])

    return run


def _meet(rotation: Broadcast, cuts: list[int], k: int):
    """The best of each (block, run): its queries' row comes first, then slabs by length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, place = None, None
        for batch in batches:
            for i in range(len(batch)):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                vectors = Vectors(r["rows"], r["ids"], r["whole"], rotation.value, cuts)
                if r["floors"] is not None:
                    if near:
                        yield near.found()
                    near, place = Nearest(vectors, k, np.frombuffer(r["floors"], "<f8")), (r["block"], r["run"])
                elif near and place == (r["block"], r["run"]):
                    near.meet(vectors)
        if near:
            yield near.found()

    return run


def nearest_by_product(
    vectors: DataFrame,
    k: int = K,
    scale: int = SCALE,
    query_every: int = QUERY_EVERY,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    slab_rows: int = SLAB_ROWS,
    block_queries: int = BLOCK_QUERIES,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for every row whose id is divisible by
    ``query_every`` the ``k`` highest inner products with other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")
    )
    ready = materialise(whole_vectors(rows, scale))
    asked = F.col("vec_id") % query_every == 0
    sizes = ready.agg(F.count(F.lit(1)).alias("rows"), F.count_if(asked).alias("queries"), F.max(F.size("whole")).alias("width")).first()
    width, parallel = max(1, sizes["width"] or 0), spark.sparkContext.defaultParallelism
    turned, cuts = fit_rotation(ready, sizes["rows"], width, sample_rows)
    rotation = spark.sparkContext.broadcast(turned)
    ranged = ready.repartitionByRange(F.col("square").desc(), "row").sortWithinPartitions(F.col("square").desc(), "row")
    slabs = materialise(ranged.mapInArrow(_slabs(width, slab_rows), SLAB).withColumn("slab", F.monotonically_increasing_id()))
    # Blocks of bounded size, and enough of them for all cores unless they get very small.
    blocks = max(1, -(-sizes["queries"] // block_queries), min(parallel, sizes["queries"] // LEAST_QUERIES))
    dealt = ready.where(asked).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    longest = slabs.orderBy(F.col("longest").desc(), "slab").select("rows", "ids", "whole").limit(1).collect()  # one slab
    head = spark.sparkContext.broadcast(tuple(map(bytes, longest[0])) if longest else (b"", b"", b""))
    queries = dealt.groupBy("block").applyInArrow(_block(width), BLOCK)
    queries = materialise(queries.mapInArrow(_first(head, rotation, cuts, k), f"{BLOCK}, floors binary, reach double"))
    runs = max(1, min(RUNS, -(-slabs.count() // RUN_SLABS)))
    # Which blocks a slab goes to, on narrow rows.
    number = slabs.select("slab", "longest", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    within = number.join(queries.select("block", "reach"), "block").where(F.col("longest") * (1 + ROUNDING) >= F.col("reach"))
    goes = within.groupBy("slab").agg(F.collect_list("block").alias("blocks"))
    guests = (
        slabs.join(goes, "slab")
        .withColumn("block", F.explode("blocks"))
        .select("block", F.pmod(F.xxhash64("slab"), F.lit(runs)).alias("run"), "longest", "rows", "ids", "whole", F.lit(None).cast("binary").alias("floors"))
    )
    hosts = queries.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long")))).select(
        "block", "run", F.lit(float("inf")).alias("longest"), "rows", "ids", "whole", "floors"
    )
    tasks = min(blocks * runs, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * parallel))
    met = hosts.unionByName(guests).repartition(tasks, "block", "run").sortWithinPartitions("block", "run", F.col("longest").desc())
    found = met.mapInArrow(_meet(rotation, cuts, k), FOUND)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
