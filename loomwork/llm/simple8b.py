"""Simple-8b: word-aligned coding of ids, with escapes and per-block offsets, and a file format of such blocks.

A word is 64 bits, the selector in its top four. Selector s packs COUNT[s] values of WIDTH[s] bits, the first in the lowest
bits; s 0 and 1 stand for 240 and 120 zeros. Selector 15 is the escape: its low 60 bits hold one value too wide for nothing
else (ids are at most 32 bits wide, so it always holds them).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import doc_key, new_path
from loomwork.llm.textkit import release_memory, text_slices
from loomwork.llm.tokens import Encoder

#: Values in a word and bits of each, by selector: fixed values of the format.
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Least value too wide for the selectors of each width, and each selector's place among the widths.
_LIMITS = np.unique(np.uint64(1) << WIDTH[:15].astype(np.uint64))
_CLASS = np.searchsorted(_LIMITS, np.uint64(1) << WIDTH.astype(np.uint64))
_STEPS = bytes([*COUNT.astype(np.uint8), *bytes(240)])
_CLASS16 = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)
_CLASS16H = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64) << np.uint64(16), "right").astype(np.uint8)
MAGIC = b"S8B1"
#: Words between two entries of a block's offset table.
STRIDE = 128
#: Ids after which a file block ends (with the document it is in).
BLOCK_IDS = 1 << 16


def _class32(ids: np.ndarray) -> np.ndarray:
    """How many of _LIMITS each value reaches, by its bit length: a table serves the low and the high half."""
    low = _CLASS16[ids & np.uint32(0xFFFF)]
    high = ids >> np.uint32(16)
    return np.where(high > 0, _CLASS16H[high], low) if high.any() else low


def encode(ids: np.ndarray) -> np.ndarray:
    """The words of ``ids`` (below 2**60), greedily: each word takes the selector that packs the most values.

    Whether a selector reaches from a position is the widest of a window of values, and wide windows come from two narrower
    ones, a byte for each value. Only the walk from word to word is a loop.
    """
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    if int(ids.max()) >> 60:
        raise ValueError("a value has over 60 bits")
    small = np.searchsorted(_LIMITS, ids, "right").astype(np.uint8) if int(ids.max()) >> 32 else _class32(ids.astype(np.uint32))
    best = np.full(n, 15, np.uint8)
    power, widest = 1, small  # of each run of ``power`` values
    for s in range(14, -1, -1):
        count = int(COUNT[s])
        if count > n:
            break
        while 2 * power <= count:
            widest = np.maximum(widest[:-power], widest[power:])
            power *= 2
        over = count - power
        reach = np.maximum(widest[: len(widest) - over], widest[over:]) if over else widest
        np.copyto(best[: len(reach)], s, where=reach <= _CLASS[s])
    steps = best.tobytes().translate(_STEPS)
    at, starts = 0, []
    while at < n:
        starts.append(at)
        at += steps[at]
    place = np.array(starts)
    chosen = best[place]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if WIDTH[s]:
            which = np.flatnonzero(chosen == s)
            first = place[which]
            word = words[which]
            for j in range(COUNT[s]):
                word |= ids[first + j] << np.uint64(j * WIDTH[s])
            words[which] = word
    return words


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of ``words``, all words of one selector at once."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNT[selectors]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selectors):
        if WIDTH[s]:
            which = np.flatnonzero(selectors == s)
            values = (words[which][:, None] >> (np.arange(COUNT[s], dtype=np.uint64) * np.uint64(WIDTH[s]))) & np.uint64((1 << int(WIDTH[s])) - 1)
            out[first[which][:, None] + np.arange(COUNT[s])] = values
    return out


def pack_block(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file block of whole documents: magic, crc32 of the rest, numbers of documents, words and ids, the documents' lengths, ids before every STRIDE-th word, words."""
    words = encode(ids)
    before = np.cumsum(COUNT[(words >> np.uint64(60)).astype(np.int64)])
    table = np.r_[0, before[STRIDE - 1 :: STRIDE]].astype("<u8")
    body = struct.pack("<QQQ", len(lengths), len(words), len(ids)) + lengths.astype("<u8").tobytes() + table.tobytes() + words.astype("<u8").tobytes()
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def unpack_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, ids as unsigned 32-bit) of a block."""
    if data[:4] != MAGIC or zlib.crc32(data[8:]) != struct.unpack_from("<I", data, 4)[0]:
        raise ValueError("not a block, or a damaged one")
    n_docs, n_words, n_ids = struct.unpack_from("<QQQ", data, 8)
    at = 32
    lengths = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
    at += 8 * n_docs + 8 * (n_words // STRIDE + 1)
    return lengths, decode(np.frombuffer(data, "<u8", n_words, at))[:n_ids].astype("<u4")


def read_ids(data: bytes, first: int, count: int) -> np.ndarray:
    """``count`` ids of a block from ``first`` on, by its offset table: only the words that hold them are decoded."""
    n_docs, n_words, _ = struct.unpack_from("<QQQ", data, 8)
    table = np.frombuffer(data, "<u8", n_words // STRIDE + 1, 32 + 8 * n_docs).astype(np.int64)
    a = int(np.searchsorted(table, first, "right")) - 1
    b = int(np.searchsorted(table, first + count, "left"))
    at = 32 + 8 * n_docs + 8 * len(table)
    words = np.frombuffer(data, "<u8", min(n_words, b * STRIDE) - a * STRIDE, at + 8 * a * STRIDE)
    return decode(words)[first - int(table[a]) :][:count].astype("<u4")


_BLOCK = "part int, block long, first_id long, n_docs long, n_ids long, doc_ids array<bigint>, data binary"


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, partitions: int | None = None) -> None:
    """Write each document's ids and ``end_id`` to ``path``, in ascending doc_id order (null last; ties by text).

    Documents are range-partitioned by id and sorted; each partition is one Parquet file of the format's blocks, so any
    store that Spark reaches can hold them. ``first_id``: ids of the partition before the block.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), doc_key().alias("k"))
    rows = rows.repartitionByRange(n, "k").sortWithinPartitions("k", "text").select("doc_id", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = Encoder.of(tokenizer)
        part = TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        names = [x.split()[0] for x in _BLOCK.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        block = first = held = 0
        ids: list[bytes] = []
        docs: list[int | None] = []

        def flush():
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            row = (part, block, first, len(docs), held, docs, pack_block(lengths, np.frombuffer(b"".join(ids), "<u4")))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        for b in batches:
            for x, y, texts in text_slices(b.column(1)):
                for doc, found in zip(b.column(0).slice(x, y - x).to_pylist(), encoder.batch(texts), strict=True):
                    ids.append(found + end)
                    docs.append(doc)
                    held += len(ids[-1]) // 4
                    if held >= BLOCK_IDS:
                        yield flush()
                        block, first, held, ids, docs = block + 1, first + held, 0, [], []
        if docs:
            yield flush()
        release_memory()

    rows.mapInArrow(run, _BLOCK).write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in the files at ``path``; ids are little-endian unsigned 32-bit numbers."""
    blocks = spark.read.schema(_BLOCK).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for first, docs, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                lengths, ids = unpack_block(data.as_py())
                raw = ids.tobytes()
                at = np.r_[0, np.cumsum(lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first + at[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array([raw[4 * x : 4 * y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=schema.names)

    # base has a row for each partition of the writer, so its size is bounded by their number, whatever the data
    return blocks.join(F.broadcast(base), "part").select((F.col("base") + F.col("first_id")).alias("first"), "doc_ids", "data").mapInArrow(run, schema)


def tokens_round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """:func:`write_ids`, then :func:`read_documents`.

    A null or empty text is the end id alone. Repeated rows are written each for itself; a null doc_id comes last and is
    read back as null. An empty table gives no rows. Other columns are not written.
    """
    path = path or new_path(spark, "ids")
    write_ids(docs, tokenizer, path, end_id)
    return read_documents(spark, path)
