"""Questions and events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kelpie.plans import retrieve


def answer_stream(queries: DataFrame, index: retrieve.Index, path: str, checkpoint: str, n: int = 5) -> StreamingQuery:
    """Each micro-batch of questions (query_id, query) through the batch plan, its results appended to a table."""

    def batch(df: DataFrame, epoch: int) -> None:
        found = retrieve.sources(retrieve.retrieve(df, index, n)).withColumn("epoch", F.lit(epoch))
        found.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")  # a repeated epoch replaces itself

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows; also for streams, where late ones are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
