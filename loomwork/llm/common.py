"""Shared storage, skew-safe lookups and connected components for the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir and runs on one machine, as in tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints/loomwork"
#: A key that holds more than 1/HEAVY_SHARE of all rows is heavy; so there are fewer than HEAVY_SHARE of them.
HEAVY_SHARE = 1024
#: A document without an id counts as one with the largest id.
NULL_ID = (1 << 63) - 1
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one, a session on one machine has LOCAL_SHARED_DIR."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or LOCAL_SHARED_DIR).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, below that of this application."""
    path = f"{shared_dir(spark)}/loomwork-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def staged(spark: SparkSession, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor costs no upstream work."""
    path = new_path(spark, name)
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What :func:`new_path` hands out inside is deleted at the end: write results elsewhere before."""
    mark = len(_made)
    try:
        yield
    finally:
        for path in _made[mark:]:
            delete(spark, path)
        del _made[mark:]


def drop_staged(spark: SparkSession) -> None:
    """Delete every folder that this application made in the shared one; call it when no result is read any more."""
    delete(spark, f"{shared_dir(spark)}/loomwork-{spark.sparkContext.applicationId}")
    _made.clear()


def hash_sample(docs: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The ``n`` rows of least hash of doc_id and text, in its order, of ``columns``; over the whole table.

    A bound on the hash lets about 1.1 n rows pass, so only so many move and are sorted, whatever the number of partitions. What
    comes out depends on the rows alone: if by chance fewer pass, those are it.
    """
    total = docs.count()
    rate = min(1.0, 1.1 * n / total) if total else 1.0
    h = F.xxhash64("doc_id", "text")
    passed = docs.filter(F.pmod(h, F.lit(1 << 32)) < int(rate * (1 << 32)))
    return passed.select(*columns, F.pmod(h, F.lit(1 << 32)).alias("_hs_low"), h.alias("_hs_all")).orderBy("_hs_low", "_hs_all").limit(n).select(*columns)


def doc_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def from_doc_key(column: Column) -> Column:
    return F.when(column != NULL_ID, column)


def skew_safe_lookup(big: DataFrame, small: DataFrame, keys: list[str], payload: list[str], count_col: str, spread: list[str]) -> DataFrame:
    """``big`` with the payload of its key in ``small`` (null where there is none).

    ``small`` has one row a key, with the number of rows of ``big`` that hold it in ``count_col``; stage it first. The first
    key is a long.
    Keys with over 1/HEAVY_SHARE of all rows, fewer than HEAVY_SHARE of them whatever the input, are broadcast; their
    rows of ``big`` are dealt out by ``spread`` in the join that finds all other keys.
    """
    columns, total = big.columns, small.agg(F.sum(count_col)).first()[0] or 0
    small = small.select(*keys, count_col, F.struct(*payload).alias("_sl_pay"))
    heavy = small.filter(F.col(count_col) * HEAVY_SHARE > total).select(*keys, F.col("_sl_pay").alias("_sl_heavy"))
    light = small.filter(F.col(count_col) * HEAVY_SHARE <= total).select(F.col(keys[0]).alias("_sl_key"), *keys[1:], "_sl_pay", F.lit(True).alias("_sl_light"))
    # rows of heavy keys go by another key and match nothing: they are not light
    big = big.join(F.broadcast(heavy), keys, "left").withColumn("_sl_light", F.col("_sl_heavy").isNull())
    big = big.withColumn("_sl_key", F.when(F.col("_sl_light"), F.col(keys[0])).otherwise(F.xxhash64(*spread)))
    out = big.join(light, ["_sl_key", *keys[1:], "_sl_light"], "left")
    found = F.coalesce("_sl_heavy", "_sl_pay")
    return out.select(*columns, *(found[p].alias(p) for p in payload))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of the graph with ``edges`` (a long, b long), as (node long, label long), label one of the nodes.

    Randomised contraction: every node moves to the neighbour (or itself) of least hash, edges follow, loops and repeats
    go. Of a path about two thirds of the nodes go in a round, so the rounds grow as the logarithm of the diameter. Only the
    number of edges left comes to the driver. No edges: no rows.
    """
    edges = staged(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels, seed = None, 0
    while edges.limit(1).count():
        order = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), c.alias("id"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = both.groupBy(F.col("a").alias("node")).agg(F.min(order(F.col("b"))).alias("_m"), F.count("*").alias("_n"))
        moves = staged(spark, _moved(moves, order), "moves")
        for end in ("a", "b"):
            look = moves.select(F.col("node").alias(end), F.col("to").alias("_to"), "_n")
            edges = skew_safe_lookup(edges, look, [end], ["_to"], "_n", ["a", "b"]).withColumn(end, F.col("_to")).drop("_to")
        edges = staged(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
        if labels is None:
            labels = moves.select("node", F.col("to").alias("label"))
        else:
            held = labels.groupBy("label").agg(F.count("*").alias("_n")).join(moves.select(F.col("node").alias("label"), F.col("to").alias("_to")), "label")
            held = staged(spark, held, "held")
            labels = skew_safe_lookup(labels, held, ["label"], ["_to"], "_n", ["node"]).select("node", F.coalesce("_to", "label").alias("label"))
        labels = staged(spark, labels, "labels")
        seed += 1
    return labels if labels is not None else spark.createDataFrame([], "node long, label long")


def _moved(moves: DataFrame, order) -> DataFrame:
    own = order(F.col("node"))
    return moves.select("node", F.when(F.col("_m") < own, F.col("_m")["id"]).otherwise(F.col("node")).alias("to"), "_n")
