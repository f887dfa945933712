"""Exact deduplication by skew-safe combining.

Rows are combined three times: within each map task, within each salted digest group,
and over the salts of a digest. Every stage groups by digest *and* full normalised
content, so equal digests of different texts never merge. A group of copies that holds
a third of all rows is spread over the salts, and what passes between stages is one row
per content, task and salt.

Edge cases: null text counts as empty (empty texts are copies of each other). Of equal
texts the row with most code points in the original text stays, then the smallest
doc_id; a null doc_id comes after every other. Repeated rows (same doc_id) count in
``group_size`` each and are marked alike. An empty table gives an empty result. Only the
id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The characters that do not count: space, tab, line feed, vertical tab, form feed, return.
WHITESPACE = " \t\n\x0b\x0c\r"
SALTS = 8


def normalise(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITESPACE, "")


def sha256(content: Column) -> Column:
    return F.sha2(F.encode(content, "UTF-8"), 256)


def _best(rank_chars: str, doc_id: str) -> Column:
    """One ordered number per row: code points first, then smaller ids (null last).

    A decimal, unlike a struct, stays in the hash aggregation's fixed-width buffer."""
    below = F.lit(2**63 - 1).cast("decimal(38,0)") - F.col(doc_id).cast("decimal(38,0)")
    return (
        F.col(rank_chars).cast("decimal(38,0)") * F.lit(str(2**65)).cast("decimal(38,0)")
        + F.coalesce(below, F.lit(-1).cast("decimal(38,0)"))
    ).cast("decimal(38,0)")


def _id_of(best: Column) -> Column:
    """The doc_id inside a :func:`_best` number."""
    width = F.lit(str(2**65)).cast("decimal(38,0)")
    chars = F.floor((best + 1) / width)
    below = best - chars.cast("decimal(38,0)") * width
    return F.when(below >= 0, (F.lit(2**63 - 1).cast("decimal(38,0)") - below).cast("long"))


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, content, best, n): one row per distinct content."""
    salted = rows.groupBy("digest", "content", "salt").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def exact_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``,
    ``digest``.

    The text is shuffled for the two combining stages only; rows then meet their winner by
    digest, on narrow rows. Digests that stand for several contents (never seen with
    SHA-256, the rule with a weak ``digest``) meet by digest and content instead.
    """

    def rows() -> DataFrame:
        raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
        content = raw.select("doc_id", F.coalesce(F.length("t"), F.lit(0)).alias("chars"), normalise(F.col("t")).alias("content"))
        return content.select(
            "doc_id",
            "content",
            _best("chars", "doc_id").alias("best"),
            digest(F.col("content")).alias("digest"),
            F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
        )

    combined = _winners(rows(), salts).groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"), F.max("best").alias("best"), F.max("n").alias("n")
    )
    winners = materialise(combined)
    alone = winners.where(F.col("contents") == 1).select("digest", "best", "n")
    out = rows().select("doc_id", "digest").join(alone, "digest")
    shared = winners.where(F.col("contents") > 1).select("digest")
    if not shared.isEmpty():
        several = rows().join(shared, "digest", "left_semi")
        out = out.unionByName(
            several.select("doc_id", "digest", "content")
            .join(_winners(several, salts), ["digest", "content"])
            .select("digest", "doc_id", "best", "n")
        )
    keep = out.select("doc_id", _id_of(F.col("best")).alias("keep_id"), F.col("n").alias("group_size"), "digest")
    return keep.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )
