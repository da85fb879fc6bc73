"""Evaluation end to end: golden questions through retrieval, answers through a judge, and the reports."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie import config, providers
from kelpie.operators import evaluate
from kelpie.plans import retrieve

#: Results (query_id, rank, product_id, type, ...) of questions (query_id, query), at most n of each.
Search = Callable[[DataFrame, int], DataFrame]


def golden(spark: SparkSession, dataset: list[dict]) -> DataFrame:
    """Golden questions (query_id, schemas.GOLDEN); expected ids and types may be single strings or lists."""
    many = lambda x: [x] if isinstance(x, str) or x is None else list(x)
    rows = [(i, d["query"], many(d["expected_product_id"]), many(d["expected_type"])) for i, d in enumerate(dataset)]
    return spark.createDataFrame(rows, "query_id int, query string, expected_product_id array<string>, expected_type array<string>")


def graded(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows (query_id, rank, rel) of results (query_id, rank, product_id, type) against golden questions."""
    rows = results.join(questions.select("query_id", "expected_product_id", "expected_type"), "query_id")
    match = evaluate.product_matches(F.col("expected_product_id"), F.col("product_id"))
    return rows.select("query_id", "rank", evaluate.relevance(match, F.col("type"), F.col("expected_type")).alias("rel"))


def evaluate_retrieval(questions: DataFrame, search: Search | retrieve.Index, k: int = config.EVAL_K, each: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows for each question (query_id, query, hit, rr, ndcg, latency) and one row (queries, k, hit_rate, mrr, ndcg, latency).

    Questions are searched as one batch, and a question's latency is its share of the batch's seconds; each: one by one,
    with seconds of their own.
    """
    spark = questions.sparkSession
    if isinstance(search, retrieve.Index):
        index = search
        search = lambda q, n: retrieve.retrieve(q, index, n)
    kind = questions.schema["query_id"].dataType.simpleString()
    asked = [r.query_id for r in questions.select("query_id").collect()]
    batches = [[i] for i in asked] if each else [asked] if asked else []
    rows, seconds = [], []
    for ids in batches:
        began = time.monotonic()
        got = search(questions.where(F.col("query_id").isin(ids)).select("query_id", "query"), k).where(F.col("rank") <= k)
        rows += [(r.query_id, r["rank"], r.product_id, r.type) for r in got.select("query_id", "rank", "product_id", "type").collect()]
        seconds += [(i, (time.monotonic() - began) / len(ids)) for i in ids]
    results = spark.createDataFrame(rows, f"query_id {kind}, rank int, product_id string, type string")
    latency = spark.createDataFrame(seconds, f"query_id {kind}, latency double")
    metrics = evaluate.query_metrics(graded(results, questions))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    by = questions.select("query_id", "query").join(metrics, "query_id", "left").join(latency, "query_id").select("query_id", "query", none("hit"), none("rr"), none("ndcg"), "latency")
    total = evaluate.summary(questions, metrics).crossJoin(latency.agg(F.avg("latency").alias("latency")))  # one row each
    return by, total.select("queries", F.lit(k).alias("k"), "hit_rate", "mrr", "ndcg", "latency")


def report(total: DataFrame) -> str:
    """The metrics as lines of text."""
    r = total.first()
    number = lambda x, form: "-" if x is None else format(x, form)
    return "\n".join([f"questions     {r.queries}", f"hit rate @ {r.k}  {number(r.hit_rate, '.2f')}%", f"MRR @ {r.k}       {number(r.mrr, '.4f')}", f"NDCG @ {r.k}      {number(r.ndcg, '.4f')}", f"mean latency  {number(r.latency, '.2f')} s"])


def faithfulness(answers: DataFrame, judge: providers.Judge = providers.offline_judge) -> DataFrame:
    """Adds statements, verifications and score to answers (answer, contexts array<string>)."""
    judged = judge(answers)
    return judged.withColumn("score", evaluate.faithfulness(F.col("statements"), F.col("verifications")))
