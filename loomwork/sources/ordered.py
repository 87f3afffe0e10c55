"""Files that hold rows in a stated order: ranges of the order key, sorted, with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomwork.operators.store import small_table

#: Rows that a file aims at.
FILE_ROWS = 1_000_000


def write_ordered(df: DataFrame, path: str, key: Column, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write ``df`` in order of ``key`` and return the manifest (number, file, rows, before), a row a file.

    Rows of equal key go by a hash of all columns. Each file is one range of keys, sorted; the manifest says which comes
    where and how many rows come before it, and is stored beside the data. No task sorts all rows.
    """
    spark = df.sparkSession
    parts = max(1, -(-df.count() // file_rows))
    ties = F.xxhash64(*(f"`{f.name}`" for f in df.schema if not isinstance(f.dataType, T.MapType)))
    rows = df.withColumns({"_key": key, "_tie": ties}).repartitionByRange(parts, "_key", "_tie").sortWithinPartitions("_key", "_tie")
    rows.select(*df.columns, "_key").write.parquet(f"{path}/data")
    found = spark.read.parquet(f"{path}/data").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"), F.min("_key").alias("first"))
    order = W.partitionBy().orderBy("first", "file")  # a row a file
    manifest = found.select(F.row_number().over(order).alias("number"), "file", "rows", F.coalesce(F.sum("rows").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("number long, file string, rows long, before long").json(f"{path}/manifest")


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """The rows with seq (long), their place in the order from 0: the manifest's count before a file, and the row's place in the file."""
    rows = spark.read.parquet(f"{path}/data").drop("_key").select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    manifest = small_table(read_manifest(spark, path).select(F.col("file").alias("_file"), "before"))
    return rows.join(manifest, "_file").withColumn("seq", F.col("before") + F.col("_at")).drop("_file", "_at", "before")
