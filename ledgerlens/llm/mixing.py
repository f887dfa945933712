"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word budget: its share of all words by weight, at most ``max_epochs``
times its own size, the excess shared again among the others by weight. A source whose
budget exceeds its size first takes complete epochs of all its documents; the rest of the
budget is a weighted sample without replacement: each document draws the exponential key
-ln(u) / w (u from a hash of its id, w its quality weight), documents are taken in
ascending key order, and the one at the budget's edge gives only the words still due.

Edge cases: null or empty texts have size 0 and take nothing; a null source is a source of
its own, last in the order of weights; sources without words have target 0; ties in the
key go by doc_id, then size; repeated rows are sampled one by one. An empty table gives an
empty result. Only the named columns are read. Runs are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BUCKET_ROWS, drawn, materialise, running_sum

WORD = "[^\\x20\\x09-\\x0D]+"
AFTER_WORD = "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])"
#: The lowest and highest quality weight, and the steps between them at which the mean
#: distribution of the keys is taken (it only spreads rows over buckets).
WEIGHT_STEPS = tuple(i / 10 for i in range(1, 11))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of a text that is ASCII lower-case letters and spaces, so that
    shouted, numeric or symbol-ridden documents come later in the sample."""
    kept = F.length(text) - F.length(F.regexp_replace(text, "[a-z ]+", ""))
    share = kept.cast("double") / F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.greatest(F.lit(WEIGHT_STEPS[0]), F.coalesce(share, F.lit(0.0)))


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """Adds ``target`` to (source, source_size, ...), one row a source.

    Filling by weight under caps, in closed form: with the sources sorted by cap / weight,
    the level is the largest share that any of them would get were all before it capped.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy(F.col("fill").asc(), F.col("rank").asc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(by_name))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1
    )
    caps = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    filled = caps.withColumn("fill", F.col("cap").cast("double") / F.col("weight"))
    due = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_fill), F.lit(0))
    sharing = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0))
    shares = filled.withColumn("share", due.cast("double") / sharing)
    level = F.greatest(F.lit(0.0), F.max("share").over(everything))
    return shares.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * level)).drop(
        "rank", "weight", "cap", "fill", "share"
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    max_epochs: int = 3,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``source_size``, ``target``,
    ``taken`` (words that the mix takes, repeats counted), ``source``.

    The text is read once, into a narrow table; a source is ordered in buckets of the key,
    whose loads differ by a bounded factor whatever the quality weights are.
    """
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("t"))
    u = (drawn(F.col("doc_id")).cast("double") + 0.5) / float(2**52)
    rows = materialise(
        raw.select(
            "doc_id",
            "source",
            word_count(F.col("t")).alias("size"),
            (-F.log(u) / quality_weight(F.col("t"))).alias("key"),
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = materialise(source_targets(sizes, weights, max_epochs)).withColumnRenamed("source", "of")
    spread = sum((F.lit(1.0) - F.exp(F.col("key") * -w) for w in WEIGHT_STEPS), F.lit(0.0)) / float(len(WEIGHT_STEPS))
    buckets = F.ceil(F.col("docs") / F.lit(bucket_rows))
    placed = rows.join(targets, rows["source"].eqNullSafe(targets["of"])).withColumn(
        "bucket", F.least(F.floor(spread * buckets), buckets - 1)
    )
    order = [F.col("key"), F.col("doc_id"), F.col("size")]
    summed = running_sum(placed.drop("of", "docs"), "source", "bucket", order, "size", "before")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    with_epochs = summed.withColumn("epochs", epochs.cast("long"))
    budget = F.round("target").cast("long") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - F.col("before")))
    return with_epochs.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + part).alias("taken"),
        "source",
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    max_epochs: int = 3,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is taken, all columns kept; the
    last time perhaps only its first words, with the white space before them. Rows that
    share a doc_id are taken alike."""
    mix = mix_sources(docs, weights, max_epochs, doc_id, source, text)
    taken = mix.groupBy(F.col("doc_id").alias("__id")).agg(F.max("taken").alias("__taken"), F.max("size").alias("__size"))
    chosen = docs.join(taken.where("__taken > 0"), docs[doc_id].eqNullSafe(F.col("__id")))
    times = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("__taken") / F.col("__size")))
    each = chosen.withColumn("__time", F.explode(times))
    words = F.least(F.col("__size"), F.col("__taken") - (F.col("__time") - 1) * F.col("__size")).cast("int")
    # Cut after each word: a part is a word and the white space before it.
    first = F.array_join(F.slice(F.split(F.col(text), AFTER_WORD), 1, words), "")
    cut = F.when(words < F.col("__size"), first).otherwise(F.col(text))
    return each.withColumn(text, cut).select(docs.columns)
