"""The operators applied to the whole ``documents`` table (``embeddings`` for inner products),
as registered queries.

``QUERIES`` maps names to functions of (spark, sf_dir); ``SQL`` has the DuckDB text of
those that SQL can express. The others are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .bfd_packing import pack_best_fit
from .exact_dedup import exact_dedup
from .hilbert_packing import pack_along_curve
from .jaccard_trie import jaccard_components
from .jump_shards import assign_shards
from .language_id import identify_languages
from .line_dedup import line_classes
from .merkle_manifest import FAN_OUT, verified_manifest
from .mixing import mix_sources
from .multiset_hash import fingerprint_with_edits
from .norm_search import nearest_by_product
from .pair_maxscore import rank_documents
from .secret_novelty import find_secrets

SEQUENCE_LENGTH = 2048
END_ID = 1
LINE_CHARS_AN_EDIT = 25
SHARDS = 8
MIX_WEIGHTS = (5.0, 2.0, 1.0)
MIX_EPOCHS = 3
TOP = 20
SCALE = 64
QUERY_EVERY = 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Packed pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pack_along_curve(documents(spark, sf_dir), tokenizer_path(), SEQUENCE_LENGTH, END_ID))


def op2_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(documents(spark, sf_dir), tokenizer_path(), SEQUENCE_LENGTH, END_ID)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(documents(spark, sf_dir), least_chars=LINE_CHARS_AN_EDIT, chars_an_edit=LINE_CHARS_AN_EDIT)


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(documents(spark, sf_dir), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))


def op7_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(documents(spark, sf_dir))


def op8_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def op9_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), width=3, num=90, den=100)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), MIX_WEIGHTS, MIX_EPOCHS)


def op11_norm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_product(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), TOP, SCALE, QUERY_EVERY)


def op12_pair_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), TOP)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(documents(spark, sf_dir))


QUERIES = {
    "op1_hilbert_packing": op1_hilbert_packing,
    "op2_bfd_packing": op2_bfd_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_jump_shards": op4_jump_shards,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_multiset_fingerprints": op7_multiset_fingerprints,
    "op8_secret_novelty": op8_secret_novelty,
    "op9_jaccard_trie": op9_jaccard_trie,
    "op10_mix_sources": op10_mix_sources,
    "op11_norm_search": op11_norm_search,
    "op12_pair_maxscore": op12_pair_maxscore,
    "op13_merkle_manifest": op13_merkle_manifest,
}

SQL = {
    "op4_jump_shards": sql.op4(SHARDS),
    "op5_exact_dedup": sql.op5(),
    "op7_multiset_fingerprints": sql.op7(),
    "op10_mix_sources": sql.op10(MIX_WEIGHTS, MIX_EPOCHS),
    "op11_norm_search": sql.op11(TOP, SCALE, QUERY_EVERY),
    "op12_pair_maxscore": sql.op12(TOP),
    "op13_merkle_manifest": sql.op13(FAN_OUT),
}
