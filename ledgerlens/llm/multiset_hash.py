"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs: pieces that end at a line break or sentence end, or
after ``MAX_PIECE`` characters, so that texts without breaks have several too; the pieces
joined give back the text. Each piece is hashed (SHA-256) into 120 lanes of one bit, and
a fingerprint sums the lanes of all pieces modulo 2^15. So it does not depend on the
order of pieces, and pieces are added or deleted by adding or subtracting their lanes
(:func:`combine`). Centred on half the number of pieces, the lanes are a +-1 random
projection of the multiset: the cosine of two fingerprints estimates that of the multisets.

Lanes are packed four to a long, 15 bits apart, so one addition sums four of them.

Edge cases: a null or empty text has no pieces and the fingerprint of the empty multiset;
it is like itself (1) and unlike every other (0). A text of more than 32,767 pieces is
summed with the carries masked. Repeated rows each get their row; if the next document's
id is repeated, its greatest text counts. Null ids come last in the descending order. An
empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

MAX_PIECE = 200
PIECES = f"[^.!?\\n]{{1,{MAX_PIECE}}}[.!?\\n]*|[.!?\\n]+"
LANE_BITS = 15
LANE_MODULUS = 1 << LANE_BITS
LANES_A_LONG = 4
HASH_LONGS = 2
LANES = HASH_LONGS * LANE_BITS * LANES_A_LONG
#: The lowest bit of each lane, and the highest.
LOW = sum(1 << (LANE_BITS * i) for i in range(LANES_A_LONG))
HIGH = LOW << (LANE_BITS - 1)
REST = LOW * (LANE_MODULUS - 1) ^ HIGH


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _add(a: Column, b: Column) -> Column:
    """Lane-wise sum modulo 2^15, no carry from lane to lane."""
    low = a.bitwiseAND(_long(REST)) + b.bitwiseAND(_long(REST))
    return low.bitwiseXOR(a.bitwiseXOR(b).bitwiseAND(_long(HIGH)))


def _negate(a: Column) -> Column:
    """Lane-wise 2^15 - a modulo 2^15."""
    return _add(_long(REST | HIGH) - a, _long(LOW))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(0))


def with_sums(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``{out}_n`` and ``{out}_sums``, the multiset hash of column ``text``.

    Hashes are taken in a projection of their own, so that the lanes share them."""

    def longs(digest: Column) -> Column:
        return F.array(*[F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(HASH_LONGS)])

    digests = F.transform(pieces(F.col(text)), lambda piece: F.sha2(F.encode(piece, "UTF-8"), 256))
    hashed = df.withColumn("__h", F.transform(digests, longs))

    def lane(which: int, shift: int) -> Column:
        def bits(h: Column) -> Column:
            return F.shiftrightunsigned(h[which], shift).bitwiseAND(_long(LOW))

        plain = F.aggregate("__h", _long(0), lambda acc, h: acc + bits(h))
        masked = F.aggregate("__h", _long(0), lambda acc, h: _add(acc, bits(h)))
        return F.when(F.size("__h") < LANE_MODULUS, plain).otherwise(masked)

    lanes = F.array(*[lane(i, s) for i in range(HASH_LONGS) for s in range(LANE_BITS)])
    return hashed.withColumns({f"{out}_n": F.size("__h").cast("long"), f"{out}_sums": lanes}).drop("__h")


def combine(n: Column, sums: Column, part_n: Column, part_sums: Column, insert: bool = True) -> tuple[Column, Column]:
    """(n, sums) of a multiset with the pieces of another inserted, or deleted."""
    if insert:
        return n + part_n, F.zip_with(sums, part_sums, _add)
    return n - part_n, F.zip_with(sums, part_sums, lambda a, b: _add(a, _negate(b)))


def fingerprint(n: Column, sums: Column) -> Column:
    """Text form: the number of pieces, then 15 hex digits a long."""
    digits = F.transform(sums, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0"))
    return F.concat(F.lower(F.hex(n)), F.lit(":"), F.array_join(digits, ""))


def centred(n: Column, sums: Column) -> Column:
    """The lanes as signed numbers around 0."""

    def unpack(x: Column) -> Column:
        parts = [F.shiftrightunsigned(x, LANE_BITS * i).bitwiseAND(_long(LANE_MODULUS - 1)) for i in range(LANES_A_LONG)]
        return F.array(*[F.pmod(v * 2 - n + LANE_MODULUS, F.lit(2 * LANE_MODULUS)) - LANE_MODULUS for v in parts])

    return F.flatten(F.transform(sums, unpack))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), _long(0), lambda acc, x: acc + x).cast("double")


def likeness(equal: Column, ab: Column, aa: Column, bb: Column) -> Column:
    """0 to 1 from the dot products of two centred lane vectors; 1 if the fingerprints are equal."""
    cosine = ab / (F.sqrt(aa) * F.sqrt(bb))
    return (
        F.when(equal, F.lit(1.0))
        .when((aa == 0) | (bb == 0), F.lit(0.0))
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))
    )


def following(docs: DataFrame, doc_id: str, payload: Column) -> DataFrame:
    """(``doc_id``, ``next_id``, ``need``): for each distinct id the next smaller one (for
    the smallest: the largest) and the largest ``payload`` among the id's rows.

    Ids are range-partitioned once; a window orders one partition, and one row a partition
    tells where the next begins."""
    ids = docs.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(payload).alias("need"))
    ranged = materialise(ids.repartitionByRange(F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id()))
    up = F.col("doc_id").asc_nulls_first()
    inside = Window.partitionBy("part").orderBy(up)
    edges = ranged.groupBy("part").agg(F.max("doc_id").alias("top"))
    by_part = Window.orderBy("part")
    whole = Window.partitionBy()
    tops = edges.select(
        F.col("part").alias("of"),
        F.lag("top").over(by_part).alias("top_below"),
        F.lag("part").over(by_part).isNull().alias("lowest"),
        F.max("top").over(whole).alias("top_of_all"),
    )
    rows = ranged.withColumn("below", F.lag("doc_id").over(inside)).withColumn("at", F.row_number().over(inside))
    next_id = (
        F.when(F.col("at") > 1, F.col("below")).when(F.col("lowest"), F.col("top_of_all")).otherwise(F.col("top_below"))
    )
    return rows.join(tops, rows["part"] == tops["of"]).select("doc_id", next_id.alias("next_id"), "need")


def fingerprint_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the text's fingerprint and that of the edited text, in
    which the last third gives way to the beginning of the next document (descending id).

    Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``. Both joins read one shuffle of
    the texts by id; what the next document lends is at most a third of the taker's length.
    """
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hashed = with_sums(raw, "text", "own")
    third = F.floor(F.length("text") / 3).cast("int")
    ring = following(raw, "doc_id", third).withColumnRenamed("doc_id", "taker")
    lent = hashed.join(ring, hashed["doc_id"].eqNullSafe(ring["next_id"])).select(
        "taker",
        F.struct(F.expr("substring(text, 1, need)").alias("head"), "own_n", "own_sums").alias("lent"),
    )
    lent = lent.groupBy("taker").agg(F.max("lent").alias("lent"))
    both = hashed.join(lent, hashed["doc_id"].eqNullSafe(lent["taker"]), "left").select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "own_n",
        "own_sums",
        F.col("lent.own_n").alias("next_n"),
        F.col("lent.own_sums").alias("next_sums"),
        F.expr(
            "concat(substring(text, 1, cast(length(text) - floor(length(text) / 3) as int)),"
            " substring(lent.head, 1, cast(floor(length(text) / 3) as int)))"
        ).alias("edited"),
    )
    out = with_sums(both, "edited", "edit")
    names = ("own", "next", "edit")
    out = out.withColumns({f"{k}_lanes": centred(F.col(f"{k}_n"), F.col(f"{k}_sums")) for k in names})
    out = out.withColumns({f"{k}_print": fingerprint(F.col(f"{k}_n"), F.col(f"{k}_sums")) for k in names})
    out = out.withColumns({f"{k}_own": dot(F.col(f"{k}_lanes"), F.col("own_lanes")) for k in names})
    out = out.withColumns({f"{k}_square": dot(F.col(f"{k}_lanes"), F.col(f"{k}_lanes")) for k in ("next", "edit")})

    def near(k: str) -> Column:
        equal = F.col("own_print") == F.col(f"{k}_print")
        return likeness(equal, F.col(f"{k}_own"), F.col("own_own"), F.col(f"{k}_square"))

    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.col("own_print").alias("fingerprint"),
        F.col("edit_print").alias("edited_fingerprint"),
        near("edit").alias("near_edited"),
        near("next").alias("near_next"),
    )
