"""The two calls of the service: answers and health. Answers collect at most n rows a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie import config, providers
from kelpie.plans import retrieve
from kelpie.sources import files


def chat(spark: SparkSession, message: str, index: retrieve.Index, n: int = config.ANSWER_N, planner=providers.identity_plan, generate: providers.Generator = providers.no_key, **more) -> dict:
    """{answer, sources, cleaned_query, sub_queries}; a blank message is an error."""
    message = (message or "").strip()
    if not message:
        raise ValueError("the message is blank")
    queries = spark.createDataFrame([(0, message)], "query_id int, query string")
    plan = planner(queries).select("plan.*").first()
    found = retrieve.retrieve(queries, index, n, planner, **more).cache()
    try:
        context = providers.context(found).first()
        answer = generate(plan.cleaned_query, context.context if context else providers.NOTHING)
        rows = retrieve.sources(found).orderBy("rank").drop("query_id", "rank").collect()
    finally:
        found.unpersist()
    return {"answer": answer, "sources": [r.asDict() for r in rows], "cleaned_query": plan.cleaned_query, "sub_queries": list(plan.sub_queries)}


def health(spark: SparkSession, path: str, models: dict[str, str] | None = None) -> DataFrame:
    """One row: status, the collections' counts and the models' names."""
    n = {r.collection: r.n for r in files.counts(spark, path).collect()}
    return spark.createDataFrame([("healthy", n.get("policy_collection", 0), n.get("product_collection", 0), models or {})], "status string, policy_chunks long, product_chunks long, models map<string,string>")


def answers(queries: DataFrame, results: DataFrame, generate: providers.Generator = providers.no_key) -> DataFrame:
    """Answers for a batch: rows (query_id, query, answer)."""
    rows = queries.join(providers.context(results), "query_id", "left").withColumn("context", F.coalesce("context", F.lit(providers.NOTHING)))
    kind = dict(queries.dtypes)["query_id"]

    def run(parts):
        for p in parts:
            yield p.assign(answer=[generate(q, c) for q, c in zip(p["query"], p["context"], strict=True)])[["query_id", "query", "answer"]]

    return rows.select("query_id", "query", "context").mapInPandas(run, f"query_id {kind}, query string, answer string")
