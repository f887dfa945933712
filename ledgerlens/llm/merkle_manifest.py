"""Merkle manifest of a dataset: a tree over each source's rows, a tree over the sources'
roots, and for every row the proof that leads from it to the one root.

A row's leaf is the SHA-256 of its columns. The rows of a source stand in the order of their
ids; every ``fan_out`` consecutive nodes are hashed into their parent until one is left.
Places come from a range sort: the rows of one range are numbered where they are, and the
ranges' counts (one row a range and source) give each its start, so no task orders a source.
``STRIDE`` levels of the tree are built per shuffle, from runs of consecutive nodes. A run keeps
its rows, and the siblings beside each of its nodes.

Proofs come by pointer jumping over the tops of runs, of which there are a ``fan_out ** STRIDE``-th
of the rows. At first each holds the siblings up to the top of the run that it lies in and points to
that. A self-join then appends to a node's segment the segment of the node that it points to and
doubles the distance to its ancestor, until all reach the root: for s strides, about log2(s)
joins. In a round only nodes whose stride is a multiple of the new distance are still needed.
One more join gives each lowest run the path of its top; only then do the runs become rows
again, each with its whole proof, so that proofs of rows are neither shuffled nor written.

Digests are hex text, and a node is the digest of its children's texts, concatenated.

Edge cases: a null is hashed as ``-``, any other value as its UTF-8 length, ``:`` and itself,
so null and empty text differ. A null source is a source of its own and comes first. A null
doc_id comes first in its source; it is not changed by
:func:`tampered`. Rows that repeat a doc_id are ordered by their leaves; equal rows have equal
leaves, next to each other, and a proof each. A lone row is its source's root, a lone source
the root of all; the proof of a lone row in a lone source is empty. An empty table gives an
empty result. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

FAN_OUT = 3
#: Levels that are built from one run of consecutive nodes, of which there are FAN_OUT ** STRIDE.
STRIDE = 5
#: Ranges get their rows by ``monotonically_increasing_id``, whose lower bits count them.
RANGE_BITS = 33

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "array<struct<before: string, after: string>>"


def hashed(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value as it is hashed: its length and itself, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return hashed(F.concat(*[field(c) for c in columns]))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``at``, (group, ``count``)): the position of each row in its group, from 0
    in ``order``, and the groups' sizes. Rows that tie keep the order in which they are read."""
    read = rows.withColumn("__read", F.monotonically_increasing_id())
    ranged = read.repartitionByRange(group, *order, "__read").sortWithinPartitions(group, *order, "__read")
    placed = materialise(ranged.drop("__read").withColumn("__place", F.monotonically_increasing_id()))
    of_range = F.shiftright("__place", RANGE_BITS)
    parts = placed.groupBy(F.col(group).alias("__group"), of_range.alias("__range")).agg(
        F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    before = Window.partitionBy("__group").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(parts.withColumn("__start", F.coalesce(F.sum("__rows").over(before), F.lit(0).cast("long"))))
    same = placed[group].eqNullSafe(starts["__group"]) & (F.shiftright(placed["__place"], RANGE_BITS) == starts["__range"])
    at = F.col("__start") + F.col("__place") - F.col("__first")
    out = placed.join(starts, same).select(*rows.columns, at.alias("at"))
    return out, starts.groupBy("__group").agg(F.sum("__rows").alias("count")).withColumnRenamed("__group", group)


def _height(count: Column, fan_out: int) -> Column:
    """Levels above ``count`` nodes until one is left, in whole numbers."""
    out, reach = F.lit(0), 1
    while reach < 1 << 62:
        out = out + (count > F.lit(reach)).cast("int")
        reach *= fan_out
    return out


def _parents(nodes: Column, fan_out: int) -> Column:
    """The next level of an array of consecutive nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fan_out).cast("int"))
    return F.transform(runs, lambda k: hashed(F.array_join(F.slice(nodes, k * fan_out + 1, fan_out), "")))


def _beside(nodes: Column, fan_out: int) -> Column:
    """For each of an array of consecutive nodes its siblings."""

    def of(_: Column, place: Column) -> Column:
        begin = place - place % fan_out
        before = F.slice(nodes, begin + 1, place - begin)
        after = F.slice(nodes, place + 2, begin + (fan_out - 1) - place)
        return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))

    return F.transform(nodes, of).cast(SEGMENT)


def levels(leaves: DataFrame, fan_out: int) -> tuple[list[DataFrame], DataFrame]:
    """(strides, roots) from (tree, at, count, node, others). A stride has ``STRIDE`` levels and a row
    for each run of its lowest: tree, run, height, ``rows`` (at, node, in the first stride the others),
    ``rise`` (its levels below the root), the siblings ``beside`` the nodes of each level, and ``top``,
    the node that the run becomes. ``roots`` are (tree, root)."""
    width, level, tall = fan_out**STRIDE, 0, None
    current = leaves.withColumn("height", _height(F.col("count"), fan_out)).drop("count")
    strides, roots = [], []
    while tall is None or level < tall:
        run = F.floor(F.col("at") / width).alias("run")
        others = [c for c in current.columns if c not in ("tree", "at", "height", "node")]
        pairs = F.sort_array(F.collect_list(F.struct("at", "node", *others))).alias("rows")
        runs = current.groupBy("tree", run, "height").agg(pairs).withColumn("level0", F.transform("rows", lambda r: r["node"]))
        for k in range(STRIDE):  # a tree that ends on the way keeps its root
            below = F.col(f"level{k}")
            runs = runs.withColumn(f"level{k + 1}", F.when(F.col("height") > level + k, _parents(below, fan_out)).otherwise(below))
        beside = [_beside(F.col(f"level{k}"), fan_out).alias(f"beside{k}") for k in range(STRIDE)]
        rise = F.least(F.lit(STRIDE), F.col("height") - level).alias("rise")
        runs = materialise(runs.select("tree", "run", "height", "rows", rise, *beside, F.element_at(f"level{STRIDE}", 1).alias("top")))
        if tall is None:
            tall = runs.agg(F.max("height")).first()[0] or 0
        strides.append(runs)
        level += STRIDE
        ended = runs.select("tree", F.col("run").alias("at"), "height", F.col("top").alias("node"))
        roots.append(ended.where(F.col("height") <= level))
        current = ended.where(F.col("height") > level)
    return strides, reduce(DataFrame.unionByName, roots).select("tree", F.col("node").alias("root"))


def _each(runs: DataFrame, fan_out: int, *more: Column) -> DataFrame:
    """The rows of the runs, with tree and ``segment``: the siblings up to the run's top, then ``more``."""
    fields = runs.schema["rows"].dataType.elementType.names

    def row(r: Column, place: Column) -> Column:
        path = F.array(*[F.element_at(f"beside{k}", F.floor(place / fan_out**k).cast("int") + 1) for k in range(STRIDE)])
        segment = F.concat(F.slice(path, F.lit(1), F.col("rise")), *more)
        return F.struct(*[r[c].alias(c) for c in fields], segment.alias("segment"))

    used = ("run", "height", "rows", "rise", "top", "more", "above", *[f"beside{k}" for k in range(STRIDE)])
    rest = [c for c in runs.columns if c not in used]
    return runs.select(*rest, F.explode(F.transform("rows", row)).alias("__row")).select(*rest, "__row.*")


def paths_to_root(strides: list[DataFrame], fan_out: int, tops: DataFrame | None = None) -> DataFrame:
    """(tree, at, node, others, segment) of the leaves that :func:`levels` had: all siblings up to
    the root, lowest first. ``tops`` (tree, above, more columns) adds its columns and ends the segments."""
    none = F.array().cast(SEGMENT)
    runs, steps, distance = strides[0], len(strides) - 1, 1
    if steps:
        upper_nodes = [_each(s, fan_out).select("tree", F.lit(k).alias("step"), "at", "segment") for k, s in enumerate(strides[1:])]
        nodes = reduce(DataFrame.unionByName, upper_nodes)
        while distance < steps:
            # Nodes that point ``distance`` strides up: those that jump now, and those that they point to.
            lower = nodes.where(F.col("step") % (2 * distance) == 0)
            upper = nodes.where(F.col("step") % (2 * distance) == distance).select(
                F.col("tree").alias("up_tree"), F.col("step").alias("up_step"), F.col("at").alias("up_at"), F.col("segment").alias("more")
            )
            points_to = (
                (F.col("tree") == F.col("up_tree"))
                & (F.col("step") + distance == F.col("up_step"))
                & (F.floor(F.col("at") / fan_out ** (STRIDE * distance)) == F.col("up_at"))
            )
            segment = F.concat("segment", F.coalesce("more", none)).alias("segment")
            jumped = lower.join(upper, points_to, "left").select("tree", "step", "at", segment)
            distance *= 2
            nodes = materialise(jumped) if distance < steps else jumped
        above_runs = nodes.where("step = 0").select("tree", F.col("at").alias("run"), F.col("segment").alias("more"))
        runs = runs.join(above_runs, ["tree", "run"], "left")
    else:
        runs = runs.withColumn("more", none)
    if tops is None:
        return _each(runs, fan_out, F.coalesce("more", none))
    return _each(runs.join(tops, "tree"), fan_out, F.coalesce("more", none), F.coalesce("above", none))


def folded(start: Column, segment: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(segment, start, lambda node, s: hashed(F.concat(s["before"], node, s["after"])))


def siblings(segment: Column) -> Column:
    """The siblings' digests, level by level, left to right."""
    return F.array_join(F.transform(segment, lambda s: F.concat(s["before"], s["after"])), "")


def dataset_proofs(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    group: str = "source",
    doc_id: str = "doc_id",
    changed: Column | None = None,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``leaf``, ``changed`` (the given column over
    ``docs``, such as the leaf of a changed row; else null), ``subroot`` (of the row's ``group``),
    ``root`` and ``segment``: the siblings on the way to the root, an array of those ``before``
    and ``after`` each node, from the leaf up (for :func:`folded` and :func:`siblings`)."""
    leaves = docs.select(
        F.col(group).alias("group"),
        F.col(doc_id).alias("doc_id"),
        leaf([F.col(c) for c in columns]).alias("leaf"),
        (F.lit(None) if changed is None else changed).cast("string").alias("changed"),
    )
    rows, counts = numbered(materialise(leaves), "group", ["doc_id", "leaf"])
    # The groups in their order are the leaves of the upper tree, and number the lower ones.
    trees, _ = numbered(counts.withColumn("upper", F.lit(0)), "upper", ["group"])
    trees = materialise(trees.select(F.col("group").alias("of"), "count", F.col("at").alias("tree")))
    rows = rows.join(trees, rows["group"].eqNullSafe(trees["of"]))
    strides, subroots = levels(rows.select("tree", "at", "count", F.col("leaf").alias("node"), "doc_id", "changed"), fan_out)
    upper = subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(trees.count()).alias("count"), F.col("root").alias("node")
    )
    upper_strides, top = levels(upper, fan_out)
    root = F.lit(next((r["root"] for r in top.collect()), None)).alias("root")  # one row
    above = paths_to_root(upper_strides, fan_out).select(
        F.col("at").alias("tree"), F.col("node").alias("subroot"), root, F.col("segment").alias("above")
    )
    paths = paths_to_root(strides, fan_out, materialise(above))
    return paths.select("doc_id", F.col("node").alias("leaf"), "changed", "subroot", "root", "segment")


def tampered(doc_id: Column, columns: Sequence[Column], text: Column) -> Column:
    """The leaf of a row without its line breaks, for about half of the ids; else null."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, leaf([*columns, F.translate(text, "\n", "")]))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, checked with the leaves of rows some of which are changed: ``doc_id``,
    ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of all siblings), ``folded_root``, ``verified``."""
    changed = tampered(F.col("doc_id"), [F.col(c) for c in COLUMNS[:-1]], F.col(COLUMNS[-1]))
    proofs = dataset_proofs(docs, changed=changed)
    return proofs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        hashed(siblings(F.col("segment"))).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("segment")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
