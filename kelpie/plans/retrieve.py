"""Retrieval end to end for a batch of queries: plan, route, search twice, fuse, pool, cap, rerank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie import config, providers
from kelpie.functions import text as T
from kelpie.operators import fusion, rerank, routing
from kelpie.operators.search import hybrid
from kelpie.shared import cut
from kelpie.sources import files


@dataclass
class Index:
    """chunks: (id, collection, text, type, product_id, product_name, section_title, embedding)."""

    chunks: DataFrame

    def products(self) -> DataFrame:
        rows = self.chunks.where("collection = 'product_collection'")
        return rows.select(F.col("product_id").alias("pid"), F.col("product_name").alias("name"), F.col("id").alias("ord"))


CHUNKS = "id string, collection string, text string, type string, product_id string, product_name string, section_title string, embedding array<float>"


def open_index(spark: SparkSession, path: str) -> Index:
    """The index at a path; where there is none, one without chunks, in which every search finds nothing."""
    found = files.read_index(spark, path)
    return Index(spark.createDataFrame([], CHUNKS) if found is None else found)


def build(product_chunks: DataFrame, policy_chunks: DataFrame, encode=None) -> DataFrame:
    """Index rows of both kinds of chunks; embeddings by encode (a pandas UDF over text)."""
    encode = encode or providers.hashed_bag()
    none = F.lit(None).cast("string")
    p = product_chunks.select(F.col("chunk_id").alias("id"), F.lit("product_collection").alias("collection"), "text", "metadata.type", "metadata.product_id", "metadata.product_name", none.alias("section_title"))
    q = policy_chunks.select(F.col("chunk_id").alias("id"), F.lit("policy_collection").alias("collection"), "text", "metadata.type", none.alias("product_id"), none.alias("product_name"), F.col("metadata.section_title").alias("section_title"))
    return p.unionByName(q).withColumn("embedding", encode("text"))


def scoped(index: Index, sub: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sub-queries with the scope each is searched in, and the chunks of those scopes.

    A scope is a collection, with a set of product ids where a product was named; chunks are repeated for the scopes
    in use only, each of which is a filter on a partition and a semi-join.
    """
    ids = F.coalesce(F.concat_ws("\x1f", F.array_sort("pids")), F.lit(""))
    sub = sub.withColumn("scope", F.concat_ws("\x1e", "collection", ids))
    scopes = sub.select("scope", "collection", F.when(F.size("pids") > 0, F.col("pids")).otherwise(F.array(F.lit(None).cast("string"))).alias("pids")).dropDuplicates(["scope"])
    wanted = scopes.select("scope", F.col("collection").alias("c"), F.explode("pids").alias("pid"))
    c = index.chunks
    whole = c.join(wanted.where("pid is null").drop("pid"), F.col("collection") == F.col("c")).drop("c")
    some = c.join(wanted.where("pid is not null"), (F.col("collection") == F.col("c")) & (F.col("product_id") == F.col("pid"))).drop("c", "pid")
    return sub, whole.unionByName(some)


def retrieve(queries: DataFrame, index: Index, n: int = config.ANSWER_N, planner=providers.identity_plan, encode=None, scorer=rerank.overlap) -> DataFrame:
    """The n best chunks (query_id, rank, id, text, type, name, product_id, rrf..., rerank_score) for queries (query_id, query)."""
    encode = encode or providers.hashed_bag()
    planned = planner(queries)
    sub = planned.select("query_id", F.posexplode("plan.sub_queries").alias("sub_pos", "query")).withColumn("parent", F.col("query_id")).withColumn("query_id", F.struct("parent", "sub_pos").cast("string"))
    bases = cut(routing.base_to_ids(index.products()))
    matched = routing.route(routing.longest_match(sub, bases))
    ids = routing.series_ids(matched, bases)
    matched = matched.join(ids, "query_id", "left").withColumn("pids", F.when(F.col("collection") == "product_collection", F.coalesce("pids", F.array())).otherwise(F.array()).cast("array<string>"))
    matched, chunks = scoped(index, cut(matched))  # every branch below reads the batch of questions
    fused = hybrid(matched.select("query_id", "query", encode("query").alias("embedding"), "scope"), chunks, config.CANDIDATES, "scope")
    names = matched.select("query_id", "parent", "sub_pos", F.col("query").alias("sub_query"))
    payload = index.chunks.select("id", "text", "type", "product_id", F.coalesce(T.blank_to_null(F.col("product_name")), F.col("section_title")).alias("name"))
    rows = fused.join(names, "query_id").drop("query_id").withColumnRenamed("parent", "query_id").join(payload, "id")
    pooled = fusion.pool(rows, ["text", "type", "product_id", "name", "rrf_score"])
    return rerank.rerank(fusion.capped(pooled, F.col("type"), ["query_id"], ["pool_pos"]), n, scorer)


def sources(results: DataFrame) -> DataFrame:
    """Results as an answer shows them."""
    return results.select("query_id", "rank", "id", T.preview(F.col("text")).alias("text"), F.coalesce("type", F.lit("N/A")).alias("type"), F.col("name").alias("product_name"), F.round("rerank_score", 4).alias("score"))
