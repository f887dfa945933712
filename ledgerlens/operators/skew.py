"""Many-to-one joins with hot keys.

A key with a third of all rows puts them into one task of a shuffle join. AQE splits such a
partition only between two plain shuffles, not where the other side is an aggregate on the
key, as totals per hash are. :func:`many_to_one` finds the heavy hitters of the many side,
deals their rows over salts in proportion to their share, and repeats only their row of the
one side, once a salt.

A key is hot when it holds more than one in ``HOT_KEYS`` of the rows, so fewer than that many
keys are: their list has a proven bound and is broadcast, whatever the tables' sizes. The
counts have map-side partial aggregates, so finding a hot key does not gather its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1024


def heavy_hitters(df: DataFrame, key: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(``__hot``, ``__salts``): the keys, null among them, with more than one in ``hot_keys`` of
    the rows (fewer than ``hot_keys`` rows), and over how many salts, two at least, to deal each."""
    counts = df.groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__rows"))
    total = df.agg(F.count(F.lit(1)).alias("__all")).scalar()
    share = F.ceil(F.col("__rows") * hot_keys / total).cast("int")
    return counts.where(F.col("__rows") * F.lit(hot_keys) > total).select("__hot", share.alias("__salts"))


def many_to_one(many: DataFrame, one: DataFrame, key: str, how: str = "left", hot_keys: int = HOT_KEYS) -> DataFrame:
    """``many`` joined with ``one`` (at most one row a ``key``) on the column ``key`` of both, hot
    keys of ``many`` in parts. Rows with a null key find nothing, and are dealt out too."""
    if how not in ("left", "inner"):
        raise ValueError(f"a many-to-one join is 'left' or 'inner', not {how!r}")
    hot = heavy_hitters(many, key, hot_keys)
    salt = F.pmod(F.monotonically_increasing_id(), F.col("__salts")).cast("int")
    dealt = many.join(F.broadcast(hot), many[key].eqNullSafe(hot["__hot"]), "left").withColumn(
        "__salt", F.coalesce(salt, F.lit(0))
    )
    salts = F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)
    repeated = one.join(F.broadcast(hot), one[key] == hot["__hot"], "left").withColumn("__salt", F.explode(salts))
    both = dealt.drop("__hot", "__salts").join(repeated.drop("__hot", "__salts"), [key, "__salt"], how)
    return both.drop("__salt")
