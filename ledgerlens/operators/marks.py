"""A runtime filter: which transfers can belong to the events of a range.

The events of a few days name few hashes, but the transfers that may price them are all those of
the transfers' range. :func:`hash_marks` marks the events' hashes in a table of bits of fixed size
(2^24 bits as at most 2^18 rows of 64), which is broadcast whatever the number of events is;
:func:`marked` keeps the transfers whose hash is marked, where they are scanned: before their
JSON is read, before totals are made, before anything is shuffled. Unmarked hashes are no
event's; a marked one may be another's by chance (with a million hashes, one in sixteen), which
the join then settles. With very many hashes all transfers pass, so it is for short ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 18
BITS = 64


def _word(tx_hash: Column) -> Column:
    return F.pmod(F.xxhash64(tx_hash), F.lit(WORDS)).cast("int")


def _bit(tx_hash: Column) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(tx_hash), 32), F.lit(BITS)).cast("int")


def hash_marks(events: DataFrame, tx_hash: str = "tx_hash") -> DataFrame:
    """(``word``, ``bits``): at most ``WORDS`` rows. Null hashes mark nothing."""
    hashed = events.where(F.col(tx_hash).isNotNull()).select(_word(F.col(tx_hash)).alias("word"), _bit(F.col(tx_hash)).alias("bit"))
    return hashed.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def marked(rows: DataFrame, marks: DataFrame, tx_hash: Column) -> DataFrame:
    """The ``rows`` whose hash may be one of the marked ones."""
    named = marks.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    found = rows.join(F.broadcast(named), _word(tx_hash) == F.col("__word"))
    return found.where(F.bit_get(F.col("__bits"), _bit(tx_hash)) == 1).drop("__word", "__bits")
