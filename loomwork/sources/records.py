"""Readers and writers: JSON lines in three tolerances, guarded sinks, fingerprints, manifests, token arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomwork.functions.text import last, simple_boxes, strip
from loomwork.operators.store import small_table

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
RAW_INSTRUCT = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "input", "target")])
RAW_CHAT = T.StructType([T.StructField("messages", T.ArrayType(MESSAGE)), T.StructField("source", T.StringType())])
RAW_DISTILL = T.StructType([T.StructField(c, T.StringType()) for c in ("repo_name", "input", "reasoning_content", "content")])
SFT = T.StructType([T.StructField(c, T.StringType()) for c in ("instruction", "reasoning", "answer", "source")])


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.globStatus(p)) if any(c in path for c in "*?[{") else fs.exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = True) -> DataFrame:
    """Rows of a JSON-lines file; blank lines don't count, a missing file has no rows, a broken line fails the query."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def without_bad_bytes(c: Column | str) -> Column:
    """A string whose bytes may not be UTF-8, without those that aren't. U+FFFD that stands in the text stays."""
    text = F.col(c) if isinstance(c, str) else c
    # what make_valid_utf8 puts in for bad bytes must not be taken for what was there: that is escaped meanwhile
    swap = lambda x, *pairs: swap(F.replace(x, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:]) if pairs else x
    escaped = swap(text, ("\ue000", "\ue000\ue001"), ("\ufffd", "\ue000\ue002"))
    cleaned = swap(F.make_valid_utf8(escaped), ("\ufffd", ""), ("\ue000\ue002", "\ufffd"), ("\ue000\ue001", "\ue000"))
    return F.when(F.is_valid_utf8(text), text).otherwise(cleaned)


def read_jsonl_dropping(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows whose line parses once bytes that aren't UTF-8 are left out; other lines go."""
    lines = spark.read.text(path).select(without_bad_bytes("value").alias("value"))
    return parse_lines(lines, schema, errors=False).filter(F.col("reject_reason").isNull()).select("row.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, file, line_number, value) of each line of the text files: seq counts from 0 over all of them in the order of their paths, line_number from 1 in each.

    A split of a file is read by one task in order, so only the numbers of lines of the splits are put together.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = lambda *by: F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("file", "_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "_block", "_first", before().alias("_all"), before("file").alias("_own"))
    at = F.col("_id") - F.col("_first")
    # a row for each split, whatever the number of lines
    return lines.join(small_table(blocks), ["file", "_block"]).select((F.col("_all") + at).alias("seq"), "file", (F.col("_own") + at + 1).alias("line_number"), "value")


def read_jsonl_quarantined(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows with seq, broken lines as file, line_number, raw_line, reject_reason and error). Lines that aren't blank are one or the other."""
    lines = numbered_lines(spark, path).withColumn("value", without_bad_bytes("value"))
    rows, bad = parse_lines(lines, schema, errors=False), F.col("reject_reason").isNotNull()
    broken = rows.filter(bad).withColumn("error", _parse_error("value"))
    return rows.filter(~bad).select("seq", "row.*"), broken.select("file", "line_number", F.col("value").alias("raw_line"), "reject_reason", "error")


def _message(line: str | None) -> str | None:
    if line is None:
        return None
    try:
        found = json.loads(line)
    except ValueError as e:
        return str(e)
    return "" if isinstance(found, dict) else f"not an object but {type(found).__name__}"


def _messages(lines: pd.Series) -> pd.Series:
    return lines.map(_message)


#: What a JSON parser says of a line; run once for a column.
_parse_error = F.pandas_udf(_messages, T.StringType()).asNondeterministic()


def parse_lines(lines: DataFrame, schema: T.StructType, value: str = "value", errors: bool = True) -> DataFrame:
    """As quarantined reading, of lines in a column: line_number stays, row is the record or null, reject_reason says why and error what the parser says.

    Only broken lines leave the JVM, for the parser's message; without ``errors`` none does.
    """
    row = F.from_json(value, schema, {"mode": "PERMISSIVE"})
    good = F.get_json_object(value, "$").isNotNull() & strip(value).startswith("{")
    out = lines.filter(strip(value) != "").withColumns({"row": F.when(good, row), "reject_reason": F.when(~good, F.lit("json_decode_error"))})
    return out.withColumn("error", _parse_error(F.when(F.col("reject_reason").isNotNull(), F.col(value)))) if errors else out


def merge_files(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Rows of the files that exist, one after the other."""
    out = spark.createDataFrame([], schema)
    for p in paths:
        out = out.unionByName(read_jsonl(spark, p, schema))
    return out


def guarded(spark: SparkSession, paths: list[str], overwrite: bool = False) -> str:
    """The save mode; raises if an output exists and may not be overwritten."""
    if not overwrite and (there := [p for p in paths if exists(spark, p)]):
        raise FileExistsError(", ".join(there))
    return "overwrite" if overwrite else "errorifexists"


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode(guarded(df.sparkSession, [path], overwrite)).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_if_absent(df: DataFrame, path: str) -> bool:
    """Whether it was written: an existing output stays as it is."""
    if exists(df.sparkSession, path):
        return False
    df.write.json(path)
    return True


#: Bytes of a file that are one row on their way to its digest, about.
CHUNK = 1 << 20
#: Endings of files that Spark's text reader would unpack.
PACKED = r"(?i)\.(gz|bz2|zst|zstd|lz4|snappy|deflate|xz)$"


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file.

    Files are read in splits, by newlines; chunks of about 1 MiB go to the task that a file's digest is made in, sorted by
    their place, and pass through it one at a time. So memory doesn't grow with a file, unless it has a line of gigabytes.
    Packed files, which the reader would unpack, are read whole.
    """
    binary = spark.read.format("binaryFile").load(path)
    files = [re.sub(r"^(\w+):///", r"\1:/", f) for f in binary.inputFiles()]  # as paths are written in _metadata
    listed = spark.createDataFrame([(f, unquote(f)) for f in files], "_file string, path string")
    packed = [unquote(f) for f in files if re.search(PACKED, f)]
    plain = [unquote(f) for f in files if not re.search(PACKED, f)] if packed else [path]
    lines = spark.read.option("lineSep", "\n").text(plain or [path]).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("data"))

    def chunks(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["path", "size", "block", "i", "data"]
        for b in batches:  # a batch's lines of one split are one chunk, and chunks of a split are numbered
            files, sizes, blocks, data = (c.to_pylist() for c in b.columns)
            first = held = 0
            for k in range(len(files) + 1):
                if k == len(files) or (files[k], blocks[k]) != (files[first], blocks[first]) or held > CHUNK:
                    if k > first:
                        at = files[first], blocks[first]
                        number[at] = number.get(at, -1) + 1
                        yield pa.RecordBatch.from_pydict(dict(zip(names, ([at[0]], [sizes[first]], [at[1]], [number[at]], [b"\n".join(data[first:k])]), strict=True)))
                    first, held = k, 0
                if k < len(files):
                    held += len(data[k]) + 1

    number: dict = {}

    def digests(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        now, state, fed, size = None, None, 0, 0
        finished = lambda: pa.RecordBatch.from_pydict({"path": [now], "sha256": [state.hexdigest()]})
        for b in batches:
            for file, total, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if file != now:
                    if now is not None:
                        state.update(b"\n" * (size - fed))
                        yield finished()
                    now, state, fed, size = file, hashlib.sha256(), 0, total
                elif fed < size:  # between chunks stood a newline
                    state.update(b"\n")
                    fed += 1
                data = data.as_py()
                state.update(data)
                fed += len(data)
        if now is not None:
            state.update(b"\n" * (size - fed))
            yield finished()

    pieces = lines.mapInArrow(chunks, "path string, size long, block long, i long, data binary")
    hashed = pieces.repartition("path").sortWithinPartitions("path", "block", "i").select("path", "size", "data").mapInArrow(digests, "path string, sha256 string")
    if packed:
        whole = spark.read.format("binaryFile").load(packed).select(F.col("_metadata.file_path").alias("path"), F.sha2("content", 256).alias("sha256"))
        hashed = hashed.unionByName(whole) if plain else whole
    sizes = binary.select(F.col("_metadata.file_path").alias("_file"), F.col("length").alias("bytes"))  # without files that are empty
    found = hashed.withColumnRenamed("path", "_file")
    out = listed.join(sizes, "_file", "left").join(found, "_file", "left")
    return out.select("path", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("sha256", F.when(F.col("bytes").isNull(), F.sha2(F.lit("").cast("binary"), 256))).alias("sha256"))


def manifest(df: DataFrame, **counts: Column) -> DataFrame:
    """One row with a JSON object of aggregates."""
    return df.agg(F.to_json(F.struct(*(c.alias(n) for n, c in counts.items()))).alias("manifest"))


def write_tokens(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """input_ids and labels as integer arrays in Parquet."""
    df.select(*(F.col(c).cast("array<int>").alias(c) for c in ("input_ids", "labels"))).write.mode(guarded(df.sparkSession, [path], overwrite)).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("input_ids array<int>, labels array<int>").parquet(path)


def from_chat(df: DataFrame) -> DataFrame:
    """Records of the first user and the first assistant message; rows without both go."""
    first = lambda role: F.try_element_at(F.filter("messages", lambda m: m["role"] == role), F.lit(1))["content"]
    out = df.select(first("user").alias("instruction"), first("assistant").alias("reasoning"), first("assistant").alias("answer"), "source")
    return out.filter(F.col("instruction").isNotNull() & F.col("reasoning").isNotNull())


def from_distilled(df: DataFrame, sources: list[str]) -> DataFrame:
    """Records of allowed sources with input and reasoning; the answer is the last simple box, else the content."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = df.filter(F.col("repo_name").isin(sources) & (text("input") != "") & (text("reasoning_content") != ""))
    return rows.select(F.col("input").alias("instruction"), F.col("reasoning_content").alias("reasoning"), F.coalesce(strip(last(simple_boxes(text("content")))), strip(text("content"))).alias("answer"), F.col("repo_name").alias("source"))
