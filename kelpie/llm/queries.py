"""The operators' queries over their whole tables, and SQL for those that SQL expresses (oracle.py).

SQL can't express the tokenizers, models, media forms, packings and seeded choices of the others; those are tested
against brute force, exact round trips and held-out rows in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm import chat_format, html_extract, jaccard_join, language_id, lattice_dedup, lexical_index, license_scan, media_chunks, mixing, packing, quality, token_counts, whitening
from kelpie.llm.common import prepare
from kelpie.llm.oracle import ORACLE_SQL  # noqa: F401


def tokenizer(name: str) -> str:
    """The file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def held_out(n: int, k: int):
    """Whether a row is kept from learning: its remainder is k. A row without a doc_id isn't."""
    return F.coalesce(remainder(n) == k, F.lit(False))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(spark, _table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.repaired_turns(spark, _table(spark, sf_dir, "conversations"))


def op3_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(spark, _table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark, _table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media_columns(spark, _table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality.learn(docs.where(~held_out(5, 0)), _table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    return quality.scored(spark, quality.statistics(docs, ["doc_id"]), rules).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out(4, 2)))
    return language_id.identify(spark, docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(spark, _table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, _table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_index.ranked(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("detections")


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_chat_format, op3_lattice_dedup, op4_token_counts, op5_packing, op6_media_chunks, op7_quality, op8_mixing, op9_language_id, op10_html_extraction, op11_whitening, op12_ranked_search, op13_license_scan)}
