"""Suffix ranks of a whole corpus by the distributed difference-cover algorithm, with Spark's range sorts alone.

Every sort is a range partitioning whose files are stored in order: a row's number is the number of rows in the files before
and its place in its own. Triples at positions that three doesn't divide get numbers so; where two are equal, the string of
their numbers is ranked in the same way, and so on; then the suffixes that were left out are merged in. See
:mod:`loomwork.llm.suffix` for when this is not the way to go: its figures are in the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwork.llm.common import new_path, staged

#: Stands for what is behind the end; less than any symbol.
END = -(1 << 62)
#: Rows that a range of a sort aims at.
RANGE_ROWS = 2_000_000


def numbered(spark: SparkSession, rows: DataFrame, keys: list[str], n: int, flag: str | None = None) -> DataFrame:
    """``rows`` with _at (long), their place from 0 in order of ``keys`` (all different), and with _flagged, how many rows before have ``flag``."""
    path = new_path(spark, "sorted")
    parts = max(1, -(-n // RANGE_ROWS), spark.sparkContext.defaultParallelism)
    rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(rows.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # a row a file, in the order of their ranges
    files = found.groupBy("_file").agg(F.count("*").alias("_n"), F.count_if(F.col(flag) if flag else F.lit(False)).alias("_f"))
    order = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    files = staged(spark, files.select("_file", *(F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}0") for c in ("_n", "_f"))), "files")
    out = found.join(F.broadcast(files), "_file").withColumn("_at", F.col("_n0") + F.col("_row"))
    if flag:
        own = F.sum(F.col(flag).cast("long")).over(W.partitionBy("_file").orderBy("_row").rowsBetween(W.unboundedPreceding, -1))
        out = out.withColumn("_flagged", F.col("_f0") + F.coalesce(own, F.lit(0)))
    return out.drop("_file", "_row", "_n0", "_f0")


def suffix_ranks(spark: SparkSession, text: DataFrame, n: int) -> DataFrame:
    """(i, r): the rank from 0 of the suffix at each position of ``text`` (i long from 0 to n - 1, c long above END)."""
    if n < 3:
        return _few(spark, text)
    pad = spark.createDataFrame([(n, END + 1)], "i long, c long") if n % 3 == 1 else None
    whole = text if pad is None else text.unionByName(pad)  # so the last triple of the first class has an end in it
    size = n + (pad is not None)
    near = F.explode(F.array(*(F.struct((F.col("i") - k).alias("at"), F.lit(k).alias("k")) for k in range(3)))).alias("p")
    of = lambda k: F.coalesce(F.max(F.when(F.col("p.k") == k, F.col("c"))), F.lit(END)).alias(f"c{k}")
    triples = staged(spark, whole.select("c", near).filter("p.at >= 0").groupBy(F.col("p.at").alias("i")).agg(of(0), of(1), of(2)), "triples")
    sample = triples.filter("i % 3 <> 0")
    many = 2 * (size // 3) + (size % 3 == 2)
    different = sample.select("c0", "c1", "c2").distinct()
    names = numbered(spark, different, ["c0", "c1", "c2"], many)
    named = staged(spark, sample.join(names, ["c0", "c1", "c2"]).select("i", F.col("_at").alias("c")), "names")
    if names.count() < many:
        # the first class, then the second
        first = size // 3 + (size % 3 == 2)
        at = F.when(F.col("i") % 3 == 1, F.expr("i div 3")).otherwise(first + F.expr("i div 3"))
        ranks = suffix_ranks(spark, named.select(at.alias("i"), "c"), many)
        named = ranks.select(F.when(F.col("i") < first, 3 * F.col("i") + 1).otherwise(3 * (F.col("i") - first) + 2).alias("i"), F.col("r").alias("c"))
    sampled = staged(spark, named.select("i", F.col("c").alias("r")), "sample-ranks")
    # every position with the ranks of the two behind it, as far as they are in the sample
    behind = lambda k: sampled.select((F.col("i") - k).alias("i"), F.col("r").alias(f"r{k}"))
    rows = triples.join(sampled, "i", "left").join(behind(1), "i", "left").join(behind(2), "i", "left")
    rows = staged(spark, rows.select("i", "c0", "c1", "r", F.coalesce("r1", F.lit(-1)).alias("r1"), F.coalesce("r2", F.lit(-1)).alias("r2"), (F.col("i") % 3 == 0).alias("rest")), "merge")
    one = numbered(spark, rows.filter("i % 3 <> 2").select("i", "r", "rest", "c0", "r1"), ["c0", "r1"], size, "rest")
    two = numbered(spark, rows.filter("i % 3 <> 1").select("i", "r", "rest", "c0", "c1", "r2"), ["c0", "c1", "r2"], size, "rest")
    # of the rest: those of the rest before, and those of either class before; of the sample: its own rank and the rest before
    own = one.filter("NOT rest").unionByName(two.filter("NOT rest"), allowMissingColumns=True).select("i", (F.col("r") + F.col("_flagged")).alias("r"))
    rest = one.filter("rest").select("i", F.col("_at").alias("a")).join(two.filter("rest").select("i", (F.col("_at") - F.col("_flagged")).alias("b")), "i")
    ranks = own.unionByName(rest.select("i", (F.col("a") + F.col("b")).alias("r")))
    if pad is not None:
        ranks = ranks.filter(F.col("i") < n).withColumn("r", F.col("r") - 1)  # the pad is the least suffix
    return staged(spark, ranks, "ranks")


def _few(spark: SparkSession, text: DataFrame) -> DataFrame:
    rows = sorted((r.i, r.c) for r in text.collect())
    symbols = [c for _, c in rows]
    order = sorted(range(len(rows)), key=lambda i: symbols[i:])
    return spark.createDataFrame([(i, r) for r, i in enumerate(order)], "i long, r long")


def symbols(spark: SparkSession, texts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """((i, c) of all ``texts`` (k long, text binary) one after the other, (k, d, first, text) of each, their length together): each text's bytes and an end of its own.

    Texts are numbered by k, equal ones in any order; nulls are empty.
    """
    rows = staged(spark, texts.select("k", F.coalesce("text", F.lit(b"")).alias("text")).withColumn("size", F.octet_length("text").cast("long")), "texts")
    total = rows.agg(F.count("*").alias("n"), F.sum(F.col("size") + 1).alias("s")).first()
    if not total.n:
        return spark.createDataFrame([], "i long, c long"), rows.select("k", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("first"), "text"), 0
    sizes = staged(spark, numbered(spark, rows, ["k"], total.n), "numbered")
    block = F.expr("_at div 4096")
    before = sizes.groupBy(block.alias("_b")).agg(F.sum(F.col("size") + 1).alias("_s")).select("_b", (F.sum("_s").over(W.orderBy("_b")) - F.col("_s")).alias("_base"))
    own = F.sum(F.col("size") + 1).over(W.partitionBy("_b").orderBy("_at")) - F.col("size") - 1
    placed = staged(spark, sizes.withColumn("_b", block).withColumn("_own", own).join(before, "_b").select("k", F.col("_at").alias("d"), (F.col("_base") + F.col("_own")).alias("first"), "text"), "placed")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for d, first, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = np.frombuffer(text.as_py(), np.uint8).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(data) + 1)), pa.array(np.r_[data, -1 - d])], names=["i", "c"])

    return placed.select("d", "first", "text").mapInArrow(cut, "i long, c long"), placed, int(total.s)


def repeated_offsets(spark: SparkSession, texts: DataFrame, length: int) -> DataFrame:
    """(k, offset): where in ``texts`` (k long, text binary) ``length`` bytes start that start somewhere else, too; no match crosses texts.

    Adjacent suffixes are compared by a 64-bit hash of their first ``length`` bytes.
    """
    from loomwork.llm.textkit import spans_hash

    text, placed, n = symbols(spark, texts)
    ranks = suffix_ranks(spark, staged(spark, text, "symbols"), n)

    def heads(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for k, first, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                buf = np.frombuffer(data.as_py(), np.uint8)
                at = np.arange(max(0, len(buf) - length + 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int64)), pa.array(at), pa.array(first + at), pa.array(spans_hash(buf, at, at + length).view(np.int64))], names=["k", "offset", "i", "h"])

    rows = staged(spark, placed.select("k", "first", "text").mapInArrow(heads, "k long, offset long, i long, h long").join(ranks, "i").drop("i"), "heads")
    following = rows.select((F.col("r") - 1).alias("r"), F.col("h").alias("h2"), F.struct("k", "offset").alias("two"))
    pairs = rows.join(following, "r").filter("h = h2")
    return pairs.select(F.explode(F.array(F.struct("k", "offset"), "two")).alias("x")).select("x.*").distinct()
