"""A corpus pipeline over documents: language ID, quality, near-duplicates, mixing, packing.

run() writes each stage as a table in the shared folder and reads it back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm import jaccard_join, language_id, mixing, packing, quality
from kelpie.llm.common import Scratch, prepare
from kelpie.llm.queries import held_out, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least share of a text's letters, times the odds, in its language; and least quality score.
LANGUAGE, QUALITY = 0.25, 0.3

#: Ids of copies that are sent to all tasks at most, some 100 MB.
FEW_COPIES = 1 << 22


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a known language: those without a letter or a text go, and those no language fits."""
    prepare(spark)
    model = language_id.fit(docs.where(~held_out(4, 2)), reject=True)
    return language_id.identify(spark, docs, model, COLUMNS).where(f"lang_pred <> 'und' and score >= {LANGUAGE}").select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the rules, learned from the labels of those that are left, score as good."""
    prepare(spark)
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(spark, quality.statistics(docs, COLUMNS), rules, QUALITY).where("predicted = 1").select(*COLUMNS)


def single(docs: DataFrame) -> DataFrame:
    """One row for each doc_id, the smallest by text, lang, source and n_chars; rows without one go. Unique rows are not shuffled."""
    docs = docs.where("doc_id is not null").select(*COLUMNS)
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    return docs.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("x")).select("doc_id", "x.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates (5-word shingles, similarity 0.8).

    Texts without words are in no group and stay. Rows that repeat a doc_id are one document; rows without one go.
    """
    docs = single(docs)
    scratch = Scratch(spark, "distinct")
    found = jaccard_join.jaccard_components(spark, docs, width=5, low=80)
    copies = scratch.save(found.where("doc_id <> component_id").select("doc_id"), "copies")
    if copies.count() <= FEW_COPIES:  # else texts are shuffled
        copies = F.broadcast(copies)
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a document comes as often as the mix takes it, 0 to 3 times.

    Rows that repeat a doc_id are one document; rows without one go.
    """
    docs = single(docs)
    took = mixing.mix(spark, docs).where("repeats > 0").select("doc_id", "repeats")
    return docs.join(took, "doc_id").withColumn("_k", F.explode(F.sequence(F.lit(1), "repeats"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; null and empty texts are one token each."""
    return packing.pack(spark, docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("quality", good), ("jaccard_join", distinct), ("mixing", mixed), ("packing", packed)]

#: The stages' models and tokenizer are beyond SQL; tests/llm tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
