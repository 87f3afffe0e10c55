"""Benchmark decontamination by spaced seeds: masks that ignore some token positions find hits, overlaps around them are verified with substitutions allowed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.textkit import IS_MARK, Words, as_bytes, mix, release_memory, text_slices

#: Token positions that a seed looks at (1) and ignores (0): fixed values.
MASKS = ("111111", "1101011001", "10110100111", "110010101011")
#: An overlap counts from so many tokens on (all of a shorter item), of which so large a share must be equal.
MIN_TOKENS = 12
MIN_SHARE = 0.75
#: Benchmark text in one pass over the documents; a larger benchmark takes several passes.
PART_BYTES = 8 << 20
#: Hits of seeds that are held at once.
HITS = 1 << 20
#: Items of fewer tokens are listed as overlaps, but no document is dropped for one: a word or two prove nothing.
MIN_ITEM_TOKENS = 5
_FILTER_BITS = 22


def tokens(texts: list[bytes]) -> Words:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return Words(texts, lower=True, breaks=IS_MARK)


def _seeds(hashes: np.ndarray, at: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(token numbers, seed hashes) of each window of the mask that lies in one text."""
    n = len(mask)
    last = np.repeat(at[1:], np.diff(at))
    where = np.flatnonzero(np.arange(len(hashes)) + n <= last)
    out = np.full(max(0, len(hashes) - n + 1), hash_of_mask(mask), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out = mix(out + hashes[j : j + len(out)])
    return where, out[where]


def hash_of_mask(mask: str) -> np.uint64:
    return mix(np.array([int("1" + mask, 2)], np.uint64))[0]


@dataclass
class Index:
    """Seeds of some benchmark items; what a worker holds. Bounded by PART_BYTES of text."""

    ids: list
    hashes: np.ndarray
    at: np.ndarray
    masks: tuple[str, ...]
    seeds: np.ndarray
    places: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[bytes], masks: tuple[str, ...] = MASKS) -> Index:
        words = tokens(texts)
        hashes = words.hashes()
        sizes = np.diff(words.at)
        spans = max(map(len, masks))
        # an item that some mask does not fit into is sought by its whole length, or by a shorter run
        short = sorted({"1" * int(n) for n in sizes if 0 < n < spans and n < MIN_TOKENS} - set(masks))
        found = [_seeds(hashes, words.at, m) for m in (*masks, *short)]
        places, seeds = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        order = np.argsort(seeds, kind="stable")
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[seeds >> np.uint64(64 - _FILTER_BITS)] = True
        return cls(ids, hashes, words.at, (*masks, *short), seeds[order], places[order], bits)


def overlap(equal: np.ndarray, min_share: float = MIN_SHARE) -> tuple[int, int, int]:
    """(first, length, equal tokens) of the longest aligned run with a share of ``min_share`` or more equal; of several, one with most equal."""
    share = Fraction(min_share).limit_denominator(10**6)
    count = np.r_[0, np.cumsum(equal, dtype=np.int64)]
    total = share.denominator * count - share.numerator * np.arange(len(count))
    # a run has the share if the total does not fall from its start to its end; the earliest such start of each end
    first = np.searchsorted(-np.minimum.accumulate(total), -total)
    length = np.arange(len(count)) - first
    got = count - count[first]
    end = int(np.lexsort((got, length))[-1])
    return int(first[end]), int(length[end]), int(got[end])


def scan(texts: list[bytes], index: Index, min_tokens: int = MIN_TOKENS, min_share: float = MIN_SHARE) -> list[tuple[int, int, int, int, int, int, int]]:
    """(text, item, item's tokens, item's first, text's first, length, equal tokens): the best overlap of each text and item."""
    words = tokens(texts)
    hashes = words.hashes()
    rows, text_of = [], words.text_of()
    item_of = np.repeat(np.arange(len(index.at) - 1), np.diff(index.at))
    for mask in index.masks:
        where, seeds = _seeds(hashes, words.at, mask)
        maybe = index.bits[seeds >> np.uint64(64 - _FILTER_BITS)]
        where, seeds = where[maybe], seeds[maybe]
        a, b = (np.searchsorted(index.seeds, seeds, side) for side in ("left", "right"))
        n = b - a
        # one seed may be at many places on both sides: some at a time, and of each text and item every shift once
        for part in np.array_split(np.arange(len(n)), int(n.sum()) // HITS + 1):
            m = n[part]
            place = index.places[np.repeat(a[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            here = np.repeat(where[part], m)
            rows.append(np.unique(np.stack([text_of[here], item_of[place], here - place], axis=1), axis=0))
    best: dict[tuple[int, int], tuple] = {}
    for text, item, shift in np.unique(np.concatenate(rows), axis=0).tolist() if rows else []:
        first, last = int(index.at[item]), int(index.at[item + 1])
        a = max(first, int(words.at[text]) - shift)
        b = min(last, int(words.at[text + 1]) - shift)
        at, length, equal = overlap(index.hashes[a:b] == hashes[a + shift : b + shift], min_share)
        if length >= min(min_tokens, last - first):
            row = (text, item, last - first, a + at - first, a + at + shift - int(words.at[text]), length, equal)
            if row[5:] > best.get((text, item), (0,) * 7)[5:]:
                best[text, item] = row
    return sorted(best.values())


def indexes(spark: SparkSession, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[Index]:
    """Indexes over all items, each of about ``part_bytes`` of text; the driver holds one at a time."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // part_bytes) or 1
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    for k in range(parts):
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        table = part.toArrow()
        texts = [x for chunk in table.column("text").chunks for x in as_bytes(chunk)]
        yield Index.of(table.column("item_id").to_pylist(), texts)


def find_overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, item_id, item_tokens, item_start, doc_start, length, equal): the best overlap of each document and item that have one.

    Tokens are runs of letters, digits and non-ASCII characters, A-Z in lower case. An overlap is an aligned run of
    ``min_tokens`` tokens or more (of the whole item, if that is shorter), in which a share of ``min_share`` or more are
    equal; the longest one of an alignment counts, and an alignment is looked at if it holds a seed. Null and empty texts, and items without tokens, overlap with nothing. Of several alignments
    of a document and an item, the one with the longest overlap counts, of these the one with most equal tokens, of these the
    first by shift. A text over a slice (half a MB) is scanned whole, on its own.
    Repeated rows each give their own. Empty tables give no rows. Other columns play no part.

    The benchmark's seeds go to the workers in parts of bounded size, so documents are scanned in place and not shuffled.
    """
    doc, item = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    names = ["item_tokens", "item_start", "doc_start", "length", "equal"]
    schema = T.StructType([T.StructField("doc_id", doc), T.StructField("item_id", item), *(T.StructField(n, T.LongType()) for n in names)])
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = None
    for index in indexes(spark, benchmark):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator, held=held) -> Iterator:
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_type

            kind = to_arrow_type(item)
            for b in batches:
                found = [(r[0] + x, *r[1:]) for x, _, texts in text_slices(b.column(1)) for r in scan(texts, held.value, min_tokens, min_share)]
                cols = list(zip(*found, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array([held.value.ids[i] for i in cols[1]], kind), *(pa.array(c, pa.int64()) for c in cols[2:])], names=schema.names)
            release_memory()

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, min_share: float = MIN_SHARE, min_item_tokens: int = MIN_ITEM_TOKENS) -> DataFrame:
    """The rows of ``docs`` without an overlap with an item of ``min_item_tokens`` tokens or more, with all columns as they are; see :func:`find_overlaps`."""
    schema = docs.schema
    at = [c.lower() for c in docs.columns].index("text")
    for index in indexes(spark, benchmark):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator, held=held) -> Iterator:
            import pyarrow as pa

            for b in batches:
                for x, y, texts in text_slices(b.column(at)):
                    bad = {r[0] for r in scan(texts, held.value, min_tokens, min_share) if r[2] >= min_item_tokens}
                    yield b.slice(x, y - x).filter(pa.array([i not in bad for i in range(y - x)], pa.bool_()))
            release_memory()

        docs = docs.mapInArrow(run, schema)
    return docs
