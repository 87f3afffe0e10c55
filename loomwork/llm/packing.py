"""Packing by power-of-two decomposition: each document falls into pieces of binary length, and pieces of one length share a bucket."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomwork.llm.common import new_path, staged
from loomwork.llm.textkit import release_memory, text_slices
from loomwork.llm.tokens import Encoder

MAX_LENGTH = 1024
#: Files whose first numbers may be broadcast: some 300 bytes each, one file a task. Beyond, ids are shuffled to meet them.
BROADCAST_FILES = 1_000_000
#: Parts of the files whose rows are counted together before those of a part are.
PARTS = 1024


def piece_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """``n`` as a sum of powers of two up to ``max_length`` (itself one), the longest first: 2500 is 1024 + 1024 + 256 + 128 + 64 + 4."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length is not a power of two")
    return [max_length] * (n // max_length) + [1 << b for b in reversed(range(max_length.bit_length() - 1)) if n % max_length >> b & 1]


def pieces(docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids) of each piece; ids are little-endian unsigned 32-bit numbers."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    piece_lengths(0, max_length)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = Encoder.of(tokenizer)
        end = end_id.to_bytes(4, "little")

        def batch(rows: list, kind: pa.DataType):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=schema.names)

        for b in batches:
            for x, y, texts in text_slices(b.column(1)):
                rows = []
                for doc, found in zip(b.column(0).slice(x, y - x).to_pylist(), encoder.batch(texts), strict=True):
                    ids = found + end
                    n, at = len(ids) // 4, 0
                    for length in piece_lengths(n, max_length):
                        rows.append((doc, at, length, n, ids[4 * at : 4 * (at + length)]))
                        at += length
                yield batch(rows, b.column(0).type)
        release_memory()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write all sequences to ``path`` (a new folder in the shared one if None), a file for each task with its lengths one after the other, and read them back.

    A sequence is one piece of one document: its length is a power of two, so it needs no padding and crosses no document.
    Each document is its ids and ``end_id``; a null or empty text is the end alone. Columns: doc_id, start (ids of the
    document before the piece), length, doc_tokens, ids, sequence_id (gapless from 0 over all buckets), offset (0).
    Repeated rows and rows without an id are packed each for itself. An empty table gives no rows.

    A file is sorted by length, so a reader of one bucket skips the other row groups by their statistics. The ids are written
    once and not shuffled; sequence_id is a row's place among its file's of that length, after those of the shorter lengths and
    of the files before.
    """
    path = path or new_path(spark, "packed")
    rows = pieces(docs, tokenizer, max_length, end_id)
    rows.sortWithinPartitions("length").write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(rows.schema).parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    runs = staged(spark, found.groupBy("length", "_file").agg(F.count("*").alias("_n"), F.min("_row").alias("_at")), "runs")
    # rows of the runs before: first over lengths and parts of the files, then within a part
    runs = runs.withColumn("_part", F.pmod(F.xxhash64("_file"), F.lit(PARTS)))
    parts = runs.groupBy("length", "_part").agg(F.sum("_n").alias("_m"))
    parts = parts.select("length", "_part", (F.sum("_m").over(W.orderBy("length", "_part")) - F.col("_m")).alias("_before"))  # PARTS rows a length
    within = F.sum("_n").over(W.partitionBy("length", "_part").orderBy("_file")) - F.col("_n")
    first = runs.withColumn("_within", within).join(F.broadcast(parts), ["length", "_part"]).select("_file", "length", (F.col("_before") + F.col("_within") - F.col("_at")).alias("_first"))
    # a row a file; ids would be shuffled to meet it, so it is broadcast unless there are very many files
    first = staged(spark, first.groupBy("_file").agg(F.map_from_entries(F.collect_list(F.struct("length", "_first"))).alias("_first")), "first-numbers")
    out = found.join(F.broadcast(first) if first.count() <= BROADCAST_FILES else first, "_file")
    return out.select("doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "ids", (F.col("_first")[F.col("length")] + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
