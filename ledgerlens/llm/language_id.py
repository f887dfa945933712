"""Language identification by nearest centroid.

A text's letters, lower-cased, give hashed byte trigrams; log counts times inverse document
frequency, normalised, are its vector. Each language has several centroids (spherical
k-means over a sample of its documents); the nearest of all by cosine names the language.
A document is rejected when it is farther from its language's centroids than documents of
that language and length are: the floor is a share of a low quantile of the cosines that
sampled documents have to centroids fitted on the sample's other half. Short texts have lower
cosines, so each class of lengths has a floor of its own, from sampled documents thinned to
the class's least length. A language with few sampled documents of a class takes the lowest
floor of the others, and without any, what random trigrams reach.

The model (document frequencies, centroids, floors) is fitted on at most
``SAMPLE_PER_LANGUAGE`` labelled rows a language, chosen by a hash of their id and text; prediction
reads every whole text and nothing but the text.

Edge cases: a null text or one without a letter is ``und``, score 0 and rejected; so is
every document when no labelled row can be learnt from. Repeated rows get the same result.
Null ids are held out or not like the empty string (they are learnt from). An empty table gives an empty result.
Only the id, text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drawn, materialise, returning_memory
from .tokens import text_parts

SAMPLE_PER_LANGUAGE = 1000
CLUSTERS = 4
DIMENSIONS = 1 << 12
ROUNDS = 8
#: Share of the sampled documents' low quantile below which a document is rejected.
SLACK = 0.5
#: The quantile; the lowest document is left out of it however few there are.
QUANTILE = 0.01
#: Sampled documents of a language and length from which they tell how far such can be.
ENOUGH = 16
#: Least trigrams of the classes of length.
LENGTHS = (1, 8, 16, 32, 64, 128, 256, 512, 1024)
#: Draws of random trigrams that tell the floor where no language has enough documents.
RANDOM_DRAWS = 200
ROWS_AT_ONCE = 256


def trigram_counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Counts over hashed byte trigrams of each text's letters; all zero without a letter."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    words = pc.utf8_trim_whitespace(pc.replace_substring_regex(low, r"[^\pL]+", " "))
    padded = pc.if_else(pc.equal(words, ""), "", pc.binary_join_element_wise(" ", words, " ", ""))
    padded = pa.concat_arrays([padded])
    offsets = np.frombuffer(padded.buffers()[1], np.int32)[padded.offset : padded.offset + len(padded) + 1]
    data = np.frombuffer(padded.buffers()[2] or b"", np.uint8)[: offsets[-1]].astype(np.uint32)
    if len(data) > 2:
        grams = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
        buckets = (grams * np.uint32(2654435761)) >> np.uint32(20)
    else:
        buckets = data[:0]
    for a, b in zip(offsets, offsets[1:], strict=False):
        yield np.bincount(buckets[a : max(a, b - 2)], minlength=DIMENSIONS)


def normalised(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts).astype(np.float32) * idf
    length = np.sqrt((weighted * weighted).sum(axis=-1, keepdims=True))
    return weighted / np.where(length == 0, 1, length)


@dataclass
class Model:
    """At most languages x ``CLUSTERS`` centroids of ``DIMENSIONS`` numbers."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    #: By centroid (its language's) and class of length.
    floors: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each row of counts."""
        total = counts.sum(axis=1)
        if not self.languages:
            return ["und"] * len(counts), np.zeros(len(counts)), np.ones(len(counts), bool)
        cosines = normalised(counts, self.idf) @ self.centroids.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines.max(axis=1).astype(float), 0, 1)
        none = total == 0
        score[none] = 0
        length = np.maximum(np.searchsorted(LENGTHS, total, side="right") - 1, 0)
        rejected = none | (score < self.floors[best, length])
        return ["und" if n else self.languages[b] for n, b in zip(none, best, strict=True)], score, rejected


def spherical_kmeans(vectors: np.ndarray, clusters: int) -> np.ndarray:
    """Unit centroids; the first seed is the mean's nearest row, the next ones the farthest."""
    mean = vectors.sum(axis=0)
    seeds = [int((vectors @ mean).argmax())]
    while len(seeds) < min(clusters, len(vectors)):
        near = (vectors @ vectors[seeds].T).max(axis=1)
        seeds.append(int(near.argmin()))
    centroids = vectors[seeds]
    for _ in range(ROUNDS):
        of = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[of == k].sum(axis=0) for k in range(len(centroids))])
        sizes = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(sizes > 0, sums / np.where(sizes == 0, 1, sizes), centroids)
    return centroids.astype(np.float32)


def thinned(counts: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The counts of ``size`` of the trigrams, drawn without replacement (fewer of larger sizes)."""
    grams = np.repeat(np.arange(DIMENSIONS), counts)
    return np.bincount(np.random.default_rng(seed).permutation(grams)[:size], minlength=DIMENSIONS)


def low_cosines(seen: np.ndarray, halves: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> list[float]:
    """Of each class of length, the low quantile of the cosines that documents thinned to its
    least length have to the centroids; NaN without enough. ``halves`` holds (positions of
    documents, centroids that have not seen them)."""
    total, out = seen.sum(axis=1), []
    for size in LENGTHS:
        cosines = []
        for at, others in halves:
            for i in at[total[at] >= size]:
                cosines.append((normalised(thinned(seen[i], size, int(i)), idf) @ others.T).max())
        low = max(1, int(QUANTILE * len(cosines)))
        out.append(float(np.sort(cosines)[low]) if len(cosines) >= ENOUGH else float("nan"))
    return out


def class_floors(low: np.ndarray, centroids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Floors by row and class of length from :func:`low_cosines`, with none missing."""
    draw = np.random.default_rng(0)
    floors = SLACK * low
    for k, size in enumerate(LENGTHS):
        known = floors[:, k][~np.isnan(floors[:, k])]
        if len(known):
            instead = known.min()
        elif k:
            noise = np.stack([np.bincount(draw.integers(0, DIMENSIONS, size), minlength=DIMENSIONS) for _ in range(RANDOM_DRAWS)])
            instead = max(np.quantile((normalised(noise, idf) @ centroids.T).max(axis=1), 1 - QUANTILE), floors[:, k - 1].min())
        else:  # a trigram or a few tell nothing
            instead = 0.0
        floors[:, k] = np.where(np.isnan(floors[:, k]), instead, floors[:, k])
    return floors


def held_out(doc_id: Column) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(3)) == 1


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for langs, texts in text_parts(batches):
        rows = [c.astype("<u4").tobytes() if c.any() else None for c in trigram_counts(texts)]
        yield pa.RecordBatch.from_arrays([langs, pa.array(rows, pa.binary())], names=["lang", "counts"])


def _as_counts(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<u4") for x in column]).astype(np.int64)


def fit(rows: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, clusters: int = CLUSTERS) -> Model:
    """From (doc_id, text, lang), learnt from rows that are labelled and not held out.

    A language's rows are drawn at the rate that gives about the bound, then cut to it, so
    the cut orders a bounded number of rows whatever share of the table the language has."""
    labelled = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # One row a language, written so that Spark knows its size and leaves the texts unmoved.
    # Rows are drawn by id and text, so rows without an id, or of one id, are drawn like others;
    # a language's lowest row is drawn whatever the rate, should all its rows be alike.
    place = drawn(F.xxhash64("doc_id", "text")) / float(2**52)
    labelled = labelled.withColumn("place", place)
    counts = materialise(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("lowest")))
    rate = F.greatest(F.lit(2.0 * per_language) / F.col("rows"), "lowest")
    few = labelled.join(counts, "lang").where(F.col("place") <= rate).select("doc_id", "text", "lang", "place")
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    sample = few.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_language)
    vectors = materialise(
        sample.select("lang", "text").mapInArrow(_count_batches, "lang string, counts binary").where("counts IS NOT NULL")
    )

    def frequencies(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, with_gram = 0, np.zeros(DIMENSIONS, np.int64)
        for part in parts:
            if len(part):
                docs += len(part)
                with_gram += (_as_counts(part["counts"]) > 0).sum(axis=0)
        yield pd.DataFrame({"gram": [-1, *range(DIMENSIONS)], "docs": [docs, *with_gram.tolist()]})

    seen = vectors.mapInPandas(frequencies, "gram int, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
    per_gram = {r["gram"]: r["docs"] for r in seen.collect()}  # DIMENSIONS + 1 rows
    docs = per_gram.get(-1, 0)
    idf = np.array([np.log((1 + docs) / (1 + per_gram.get(g, 0))) + 1 for g in range(DIMENSIONS)], np.float32)

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("counts")
        seen = _as_counts(part["counts"])
        unit = normalised(seen, idf)
        centroids = spherical_kmeans(unit, clusters)
        fold, halves = np.arange(len(part)) % 2, []
        if len(part) > 1:  # how near are documents that the centroids have not seen?
            halves = [(np.flatnonzero(fold == k), spherical_kmeans(unit[fold != k], clusters)) for k in (0, 1)]
        low = low_cosines(seen, halves, idf)
        return pd.DataFrame(
            {
                "lang": part["lang"].iloc[0],
                "centroid": [c.astype("<f4").tobytes() for c in centroids],
                "low": [low] * len(centroids),
            }
        )

    learnt = vectors.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, low array<double>")
    made = sorted((r["lang"], bytes(r["centroid"]), r["low"]) for r in learnt.collect())
    if not made:
        return Model(idf, np.zeros((0, DIMENSIONS), np.float32), [], np.zeros((0, len(LENGTHS))))
    centroids = np.stack([np.frombuffer(c, "<f4") for _, c, _ in made])
    # Missing quantiles arrive as nulls: NaN again as floats.
    return Model(idf, centroids, [lang for lang, _, _ in made], class_floors(np.array([x for _, _, x in made], float), centroids, idf))


def _predict(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_parts(batches):
            for a in range(0, len(texts), ROWS_AT_ONCE):
                part = texts.slice(a, ROWS_AT_ONCE)
                langs, score, rejected = model.predict(np.stack(list(trigram_counts(part))))
                arrays = [ids.slice(a, ROWS_AT_ONCE).cast(pa.int64()), pa.array(langs), pa.array(score), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def identify_languages(
    docs: DataFrame,
    per_language: int = SAMPLE_PER_LANGUAGE,
    clusters: int = CLUSTERS,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``lang_pred``, ``score``
    (cosine to the nearest centroid, 0 to 1) and ``rejected``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = fit(rows, per_language, clusters)
    out = rows.select("doc_id", "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def _accepted(model: Model):
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in returning_memory(parts):
            kept = [np.zeros(0, bool)]
            for a in range(0, len(texts), ROWS_AT_ONCE):
                _, _, rejected = model.predict(np.stack(list(trigram_counts(texts.slice(a, ROWS_AT_ONCE)))))
                kept.append(~rejected)
            yield pa.array(np.concatenate(kept))

    return F.arrow_udf(run, "boolean")


def accepted_documents(
    docs: DataFrame,
    per_language: int = SAMPLE_PER_LANGUAGE,
    clusters: int = CLUSTERS,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """The rows of ``docs``, all columns, that are not rejected. Only the text goes through Python."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = fit(rows, per_language, clusters)
    return docs.where(_accepted(model)(F.col(text)))
