"""Retrieval and faithfulness metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def product_matches(expected: Column, got: Column) -> Column:
    """Whether any expected id is the one found, or one is the other followed by a hyphen; blank ids count as N/A."""
    known = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "N/A").otherwise(c)
    raw = F.coalesce(got, F.lit(""))

    def one(e: Column) -> Column:
        x = F.coalesce(e, F.lit(""))
        prefix = F.startswith(raw, F.concat(x, F.lit("-"))) | F.startswith(x, F.concat(raw, F.lit("-")))
        return (known(e) == known(got)) | ((x != "N/A") & (x != "") & prefix)

    return F.exists(expected, one)


def relevance(matches: Column, type_: Column, expected_types: Column) -> Column:
    """2: product and type; 1: product only; 0: neither."""
    return F.when(matches & F.coalesce(F.array_contains(expected_types, type_), F.lit(False)), 2).when(matches, 1).otherwise(0)


def query_metrics(ranked: DataFrame, by: str = "query_id") -> DataFrame:
    """Rows (by, hit, rr, ndcg) of results (by, rank from 1, rel); the ideal order is that of the results themselves."""
    gain = lambda rank: (F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col(rank) + 1.0)
    ideal = ranked.withColumn("best", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("rel"), "rank")))
    m = ideal.groupBy(by).agg(F.min(F.when(F.col("rel") == 2, F.col("rank"))).alias("first"), F.sum(gain("rank")).alias("dcg"), F.sum(gain("best")).alias("idcg"))
    return m.select(by, F.col("first").isNotNull().cast("int").alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), "dcg", "idcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def summary(queries: DataFrame, metrics: DataFrame, by: str = "query_id") -> DataFrame:
    """One row (queries, hit_rate in percent, mrr, ndcg); queries without results count 0."""
    all_ = queries.select(by).join(metrics, by, "left")
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return all_.agg(F.count("*").alias("queries"), (100 * mean("hit")).alias("hit_rate"), mean("rr").alias("mrr"), mean("ndcg").alias("ndcg"))


def faithfulness(statements: Column, verifications: Column) -> Column:
    """Supported verifications by the number of statements; 1 without statements, null without verifications."""
    n = F.coalesce(F.size(statements), F.lit(0))
    held = F.size(F.filter(verifications, lambda v: F.coalesce(v["supported"], F.lit(False))))
    return F.when(n <= 0, 1.0).when(F.coalesce(F.size(verifications), F.lit(0)) <= 0, F.lit(None)).otherwise(held / n)
