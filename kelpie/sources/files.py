"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, NumericType, StringType, StructType
from pyspark.sql.utils import AnalysisException

from kelpie.functions import text as T


#: In a folder whose part files together are one JSON array.
ARRAY = "_array"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """Records of a JSON array, of an array in parts or of JSON lines, with their order in ord; no rows where there is no file.

    tolerant: a file that isn't a JSON array has no rows; otherwise it is an error.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("ord", F.lit(0).cast("long"))
    if exists(spark, f"{path}/{ARRAY}"):
        rows = read_json_array(spark, path, schema)
    elif not tolerant:
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    else:
        whole = spark.read.option("wholetext", True).text(path)
        rows = whole.select(F.inline(F.from_json("value", f"array<struct<{schema}>>")))
    return rows.withColumn("ord", F.monotonically_increasing_id())


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """Products (ord, id, name, url) of a list with a URL on each line."""
    rows = spark.read.text(path).select(T.strip(F.col("value")).alias("url")).where("url <> ''").withColumn("ord", F.monotonically_increasing_id())
    return rows.select("ord", T.url_id(F.col("url")).alias("id"), F.lit(None).cast("string").alias("name"), "url")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of an array that many tasks have written (shop.py), by lines, so that many tasks read a large one."""
    lines = spark.read.text(path, pathGlobFilter="part-*-1.json").select(F.regexp_replace("value", "^,", "").alias("value")).where("value <> ''")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def matching(wanted: dict) -> Column:
    """A filter on metadata: {column: value}, {column: {"$in": [values]}}, {"$and": [filters]}; all conditions of one must hold."""
    on = F.lit(True)
    for key, value in wanted.items():
        if key == "$and":
            for part in value:
                on = on & matching(part)
        elif isinstance(value, dict):
            if set(value) != {"$in"}:
                raise ValueError(f"unknown condition {value}")
            on = on & F.col(key).isin(list(value["$in"]))
        else:
            on = on & (F.col(key) == F.lit(value))
    return on


def flat_metadata(df: DataFrame, column: str = "metadata") -> DataFrame:
    """A struct's fields as strings, numbers and booleans; others as JSON. A null stays null."""
    scalar = (StringType, NumericType, BooleanType)
    fields = [F.col(f"{column}.{f.name}").alias(f.name) if isinstance(f.dataType, scalar) else F.to_json(f"{column}.{f.name}").alias(f.name) if isinstance(f.dataType, (StructType, ArrayType, MapType)) else F.col(f"{column}.{f.name}").cast("string").alias(f.name) for f in df.schema[column].dataType.fields]
    return df.withColumn(column, F.struct(*fields))


def write_index(chunks: DataFrame, path: str) -> None:
    """The index: one table partitioned by collection, rebuilt as a whole; metadata as top-level columns, so filters reach the scan."""
    chunks.write.mode("overwrite").partitionBy("collection").parquet(path)


def read_index(spark: SparkSession, path: str, collection: str | None = None, where: str | dict | None = None) -> DataFrame | None:
    """The index or one of its collections, filtered by SQL or by matching(); None where there is none."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    df = df.where(F.col("collection") == collection) if collection else df
    return df.where(matching(where) if isinstance(where, dict) else where) if where else df


def counts(spark: SparkSession, path: str, collections: tuple[str, ...] = ("policy_collection", "product_collection")) -> DataFrame:
    """Rows in each collection, 0 where it is missing."""
    names = spark.createDataFrame([(c,) for c in collections], "collection string")
    df = read_index(spark, path)
    if df is None:
        return names.withColumn("n", F.lit(0).cast("long"))
    return names.join(df.groupBy("collection").agg(F.count("*").alias("n")), "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("n"))
