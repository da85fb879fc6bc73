"""What the operators share: tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that a worker takes up at once, and that are sent to it at once.
ROWS = 1024
#: Edges that one task joins to components at most.
FEW = 1 << 20


def prepare(spark: SparkSession) -> None:
    """A path for local workers to find this package, and batches of ROWS rows at most.

    The batches are a setting of the session; results don't depend on it, but executors' memory does: texts come in
    batches of up to 64 MB without it, one in the JVM and one in the worker of each core.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= ROWS:
        spark.conf.set(setting, str(ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def in_slices(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), where run gets ROWS rows at once, whatever the session's batches are."""
    return df.mapInArrow(lambda batches: run(b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one on a local master where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kelpie-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """Tables of one run of one operator, written to the shared folder so that no lost executor costs a recomputation."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/kelpie-{name}-{uuid.uuid4().hex}"
        self._fs(self.root, "deleteOnExit")

    def _fs(self, path: str, call: str, *more) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if call == "deleteOnExit":
            fs.mkdirs(p)
        getattr(fs, call)(p, *more)

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.root}/{tag}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        for tag in tags:
            self._fs(f"{self.root}/{tag}", "delete", True)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) of one task to stars: rows (id, component_id), component_id the smallest id reached."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if got:
        ids, at = np.unique(np.concatenate([x for uv in got for x in uv]), return_inverse=True)
        ends = np.split(at, np.cumsum([len(x) for uv in got for x in uv])[:-1])
        i, j, root = np.concatenate(ends[::2]), np.concatenate(ends[1::2]), np.arange(len(ids))
        while len(i):
            a, b = root[i], root[j]
            i, j, a, b = (x[a != b] for x in (i, j, a, b))
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "component_id"])


def components(scratch: Scratch, edges: DataFrame, tag: str = "cc", few: int = FEW) -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, component_id), component_id the smallest id reached.

    While there are more than `few` edges, alternates large-star and small-star steps (Kiveris et al., 2014): each hangs
    neighbours under the smallest neighbour, so the edges turn into stars in O(log^2 n) rounds, whatever the diameter.
    Every round is a partial aggregation and an equi-join whose small side has one row per id, so a hub is split as any
    skewed key; the edges of each round are a table in the shared folder. At most `few` edges are joined by one task,
    16 MB of them, in place of as many rounds; the result is the same. Only a count and a checksum reach the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, state, k = scratch.save(e, f"{tag}0"), None, 0
    n = e.count()
    while n > few:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        k += 1
        e = scratch.save(small, f"{tag}{k}")
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        scratch.drop(f"{tag}{k - 1}")
        if now == state:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
        state, n = now, now[0]
    return scratch.save(e.coalesce(1).mapInArrow(_stars, "id long, component_id long"), f"{tag}-stars")
