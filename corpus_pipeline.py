"""A training corpus from ``documents``: each stage works on all that the one before kept.

``STAGES`` lists (name, function of (spark, docs, sf_dir)); :func:`run` applies them, each
result written as Parquet and read again as the next one's input. All but the last return
the columns of ``documents``; ``n_chars`` follows the text.

No stage reads anything but its ``docs``, so the rows are those of the documents given.
Language models, edit joins and packing are beyond SQL: ``ORACLE_SQL`` is None, and
``tests/llm/test_pipeline.py`` holds the stages against plain re-computations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import materialise
from ledgerlens.llm.hilbert_packing import pack_along_curve
from ledgerlens.llm.jaccard_trie import jaccard_components
from ledgerlens.llm.language_id import accepted_documents
from ledgerlens.llm.line_dedup import dedup_lines
from ledgerlens.llm.mixing import mixed_documents
from ledgerlens.llm.queries import (
    END_ID,
    MIX_EPOCHS,
    MIX_WEIGHTS,
    SEQUENCE_LENGTH,
    documents,
    piece_digests,
    tokenizer_path,
)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject."""
    return accepted_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every class of equal or nearly equal lines but once; documents with nothing left go."""
    return _measured(dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents alike (5-word shingles, similarity 0.8), one row: of the
    smallest id, the first by text, then the other columns. Rows without an id all stay."""
    groups = jaccard_components(docs, width=5, num=80, den=100)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy("doc_id").orderBy("text", *others)
    # The join has dealt the rows by doc_id already.
    numbered = docs.join(first, "doc_id", "left_semi").withColumn("__at", F.row_number().over(order))
    return numbered.where("__at = 1").select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights."""
    return _measured(mixed_documents(docs, MIX_WEIGHTS, MIX_EPOCHS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences along the curve."""
    return piece_digests(pack_along_curve(docs, tokenizer_path(), SEQUENCE_LENGTH, END_ID))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("source_mix", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
