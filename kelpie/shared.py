"""Intermediate tables, and where workers find this package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def find_package(spark: SparkSession) -> None:
    """Local workers import this package from where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one on a local master, as in tests, where none is named."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kelpie-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def grouped(writer: DataFrameWriter, together: int) -> DataFrameWriter:
    return writer.option("parquet.block.row.count.limit", together)


def written(df: DataFrame, together: int | None = None) -> DataFrame:
    """df as a table in the shared folder, removed when the session ends: a later read takes the columns that it needs.

    together: rows of a row group at most. Writers and readers hold a group of rows, and count no bytes before 100 of them, so long rows need few.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kelpie-{uuid.uuid4().hex}"
    (grouped(df.write, together) if together else df.write).option("compression", "zstd").parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint, for rows that several branches of a plan read: worked out once, with a short plan.

    Checkpoints go to the folder that the cluster names in spark.checkpoint.dir; on a local master, as in tests, to a
    temporary one where none is named. Elsewhere that is an error, as executors share no other folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="kelpie-"))
    return df.checkpoint()


def parts(spark: SparkSession) -> int:
    """How many parts a scan is dealt out to when the other side is copied to each: by the cluster's cores, so copies don't grow with the input."""
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), 1)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out where it has fewer partitions than the cluster has cores, as a table of one small file has; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
