"""Reranking of pooled candidates by a pluggable scorer of (sub-query, text) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie import config
from kelpie.functions import text as T


def overlap(query: Column, text: Column) -> Column:
    """The offline scorer: the share of a query's distinct tokens that the text has."""
    q = F.array_distinct(T.tokens(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, T.tokens(text))) / F.size(q))


def rerank(pool: DataFrame, n: int, scorer=overlap) -> DataFrame:
    """The n best of a pool (query_id, id, pool_pos, text, retrieved_by) by their best sub-query; ties in pool order.

    Scores are made row by row without a shuffle; the only exchange is that of the window over query_id.
    """
    best = F.aggregate(F.transform("retrieved_by", lambda s: scorer(s, F.col("text"))), F.lit(config.RERANK_FLOOR), lambda a, x: F.greatest(a, x))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "pool_pos")
    return pool.withColumn("rerank_score", best).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def rerank_pairs(pool: DataFrame, n: int, score_udf) -> DataFrame:
    """The same by a pandas UDF over (sub_query, text) pairs, such as a cross-encoder held by each worker."""
    pairs = pool.withColumn("sub_query", F.explode("retrieved_by")).withColumn("s", score_udf("sub_query", "text"))
    best = pairs.groupBy("query_id", "id").agg(F.greatest(F.max("s"), F.lit(config.RERANK_FLOOR)).alias("rerank_score"))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "pool_pos")
    return pool.join(best, ["query_id", "id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
