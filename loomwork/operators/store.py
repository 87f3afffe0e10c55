"""Tables that an operator reads again: small ones by value, others in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be held in the driver and broadcast; a larger one is stored and shuffled.
SMALL_ROWS = 50_000
#: Used only where the session names no spark.checkpoint.dir and runs on one machine, as in tests.
LOCAL_DIR = "/tmp/checkpoints/loomwork"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session on one machine may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or LOCAL_DIR).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, below one of the application, where nothing is yet."""
    return f"{shared_folder(spark)}/loomwork-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    spark, schema = df.sparkSession, df.schema
    path = fresh_path(spark, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def held(df: DataFrame, rows: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """``df``, evaluated once, and whether it is small: then its rows come from the driver, else from a stored table."""
    found = df.limit(rows + 1).collect()
    if len(found) <= rows:
        return df.sparkSession.createDataFrame(found, df.schema), True
    return stored(df), False


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where fewer partitions hold it, as those of a few small files; else as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def small_table(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has so few rows, by count; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def drop_stored(spark: SparkSession) -> None:
    """Delete what this application has stored in the shared folder; call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/loomwork-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
