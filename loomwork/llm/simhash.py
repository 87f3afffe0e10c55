"""SimHash near-dedup: fingerprints, blocks that close pairs share, Hamming verification, components.

Two settings. Fingerprints of 64 bits and a small distance: blocks by the pigeonhole principle, so no pair is missed.
Wide fingerprints for a similarity of shingle sets: at 0.8 about an eighth of the bits differ, which leaves pigeonhole
blocks of a few bits; there, fixed random blocks serve, enough of them to meet nearly all such pairs (see wide_plan).
Wide fingerprints only find candidates: of what they link, the shingle sets themselves are compared (see similar_edges).
Similar sets that no block brings together are found by an exact way of their own (see further_edges), so no link is lost.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwork.llm.common import components, doc_key, from_doc_key, hash_sample, skew_safe_lookup, staged
from loomwork.llm.textkit import Words, mix, release_memory, slices, text_slices, whole_windows, windows_hash

#: Pigeonhole: a fingerprint falls into distance + EXTRA blocks; a pair within the distance shares EXTRA of them at least.
EXTRA = 2
#: Fingerprints under one key that a worker compares at once; a key with more of them is split by further blocks.
MAX_BUCKET = 4096
SEED = 42

#: Wide fingerprints: 64-bit words, and the bits that may differ. Sets of Jaccard similarity J differ in a share
#: acos(2J / (1 + J)) / pi of the bits: 38.8 of 256 at 0.8, with a standard deviation of 5.7; unrelated ones in 128.
WIDE_WORDS = 4
WIDE_DISTANCE = 50
#: Random blocks: bits of each at least, fingerprints without likeness that one key should hold, the probability with which a
#: pair at similarity 0.8 meets in one of the blocks (0.998 at 0.85), and the share of bits in which such a pair differs.
WIDE_BITS = 16
WIDE_KEY = 16
WIDE_RECALL = 0.972
WIDE_SHARE = 0.1516
#: Fingerprints, and shingle sets, that are compared in one task; where more meet, each pair of blocks of them is a task.
KEY_BLOCK = 8192
SET_BLOCK = 1024
#: Rounds in which the sets of a large label are compared with one of them, each time another.
HUBS = 3
#: The similarity from which documents are near copies, and the bits beyond which sets linked by others are not compared:
#: seven standard deviations above the mean at 0.8.
SIMILARITY = 0.8
WIDE_SURE = 80
#: Shingles that one comparison of a set with others gathers at once.
GATHER = 1 << 20
#: Documents in whose sets common shingles are counted, and how many of those go to the workers. They only order the shingles.
ORDER_SAMPLE = 4096
ORDER_SHINGLES = 1 << 16
#: Levels of keys at most; at the last one keys are compared whole, in blocks if they are large. Only pigeonhole blocks are
#: split: random ones would lose pairs at each level, so wide keys are always compared whole.
MAX_LEVELS = 4

Masks = list[tuple[int, ...]]


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many of the rows (n, k bytes) have each bit set, the lowest bit of each byte first."""
    total = np.zeros(8 * rows.shape[1], np.int64)
    for a in range(0, len(rows), 255):
        total += np.unpackbits(rows[a : a + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return total


def fingerprint(text: bytes, shingle: int = 3, seed: int = SEED) -> np.ndarray:
    """64 bits of one text, as one uint64; a bit is 1 if set in over half the shingles' XXH64. A-Z in lower case, repeats count."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(b" ".join(words[i : i + shingle]), seed) for i in range(max(1, len(words) - shingle + 1))], "<u8")
    return majority(hashes.view(np.uint8).reshape(-1, 8))


def majority(rows: np.ndarray) -> np.ndarray:
    return np.packbits(2 * bit_counts(rows) > len(rows), bitorder="little").view("<u8").astype(np.uint64)


def shingle_sets(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """Of each text the ascending hashes of its different shingles (of all its words, if they are fewer). No words: none."""
    for a, b in slices(texts):
        words = Words(texts[a:b], lower=True)
        hashes = words.hashes()
        at = whole_windows(words, shingle)
        keys = windows_hash(hashes, shingle)[at]
        edge = np.searchsorted(at, words.at)
        for i in range(b - a):
            mine = np.unique(keys[edge[i] : edge[i + 1]])
            if not len(mine) and words.at[i + 1] > words.at[i]:
                mine = windows_hash(hashes[words.at[i] : words.at[i + 1]], int(words.at[i + 1] - words.at[i]))
            yield mine


def wide_fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    """WIDE_WORDS words for each text, from the set of its shingles. No words: zeros."""
    return wide_of(list(shingle_sets(texts, shingle)))


def wide_of(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), WIDE_WORDS), np.uint64)
    salts = mix(np.arange(1, WIDE_WORDS + 1, dtype=np.uint64))
    for i, mine in enumerate(sets):
        if len(mine):
            out[i] = majority(mix(mine[:, None] ^ salts).astype("<u8").view(np.uint8).reshape(-1, 8 * WIDE_WORDS))
    return out


def prefix_size(m: int, similarity: float = SIMILARITY) -> int:
    """Of two sets that have the similarity, in one order of all shingles, the first so many of each share one."""
    return m - math.ceil(similarity * m - 1e-9) + 1 if m else 0


def prefix(mine: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles of an ascending set: rare ones before the ``common`` (ascending), those by their ``times``, then by hash."""
    if not len(common):
        return mine[: prefix_size(len(mine))]
    at = np.minimum(np.searchsorted(common, mine), len(common) - 1)
    return mine[np.argsort(np.where(common[at] == mine, times[at], 0), kind="stable")[: prefix_size(len(mine))]]


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts of a sample (ascending), the most frequent ones, and in how many of its texts they are."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for _, _, texts in text_slices(b.column(0)):
                for mine in shingle_sets(texts, shingle):
                    yield pa.RecordBatch.from_arrays([pa.array(mine.view(np.int64))], names=["g"])
        release_memory()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = hash_sample(docs, ["text"], ORDER_SAMPLE).select(text.alias("text"))
    found = sample.mapInArrow(cut, "g long").groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "g").limit(ORDER_SHINGLES).collect()
    common = np.array([r.g for r in found], np.int64).view(np.uint64)
    order = np.argsort(common)
    return common[order], np.array([r.n for r in found], np.int64)[order]


def fingerprints(docs: DataFrame, shingle: int, wide: bool = False) -> DataFrame:
    """(_k, _th, doc_id, f0, f1, ...) of each row: its document key, a hash of its text, its fingerprint as signed longs.

    Wide ones also have _set, m and pre: a hash of the shingle set, its size and its prefix.
    """
    width = WIDE_WORDS if wide else 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["_k", "_th", "doc_id", *(f"f{i}" for i in range(width)), *(["_set", "m", "pre"] if wide else [])]
    common, times = common_shingles(docs, shingle) if wide else (None, None)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for b in batches:
            for x, y, texts in text_slices(b.column(3)):
                more = []
                if wide:
                    sets = list(shingle_sets(texts, shingle))
                    fps = wide_of(sets)
                    first = [prefix(s, common, times).view(np.int64) for s in sets]
                    edge = np.r_[0, np.cumsum([len(p) for p in first])].astype(np.int32)
                    ids = np.array([xxhash.xxh64_intdigest(s.astype("<u8").tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                    more = [pa.array(ids), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(edge, pa.array(np.concatenate(first)))]
                else:
                    fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).reshape(-1, 1)
                yield pa.RecordBatch.from_arrays([*(c.slice(x, y - x) for c in b.columns[:3]), *(pa.array(fps[:, i].copy().view(np.int64)) for i in range(width)), *more], names=names)
        release_memory()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(doc_key().alias("_k"), F.xxhash64(text).alias("_th"), "doc_id", text.alias("text"))
    return rows.mapInArrow(run, f"_k long, _th long, doc_id {kind}, " + ", ".join(f"f{i} long" for i in range(width)) + (", _set long, m int, pre array<long>" if wide else ""))


def _as_words(bits: list[int], width: int) -> tuple[int, ...]:
    out = [0] * width
    for b in bits:
        out[b // 64] |= 1 << b % 64
    return tuple(out)


def pigeonhole_masks(mask: tuple[int, ...], distance: int) -> Masks:
    """``mask`` with EXTRA of distance + EXTRA blocks of the other bits, each way: whoever differs in ``distance`` of those at most agrees under one."""
    free = [i for i in range(64 * len(mask)) if not mask[i // 64] >> i % 64 & 1]
    blocks = np.array_split(np.array(free, dtype=int), distance + EXTRA)
    chosen = [_as_words([int(b) for k in c for b in blocks[k]], len(mask)) for c in combinations(range(distance + EXTRA), EXTRA)]
    return [tuple(x | y for x, y in zip(mask, m, strict=True)) for m in chosen]


def random_masks(mask: tuple[int, ...], tables: int, bits: int) -> Masks:
    """``mask`` with ``bits`` of its other bits, ``tables`` times; always the same ones."""
    free = [i for i in range(64 * len(mask)) if not mask[i // 64] >> i % 64 & 1]
    rnd = random.Random(f"{mask} {tables} {bits}")
    chosen = [_as_words(rnd.sample(free, min(bits, len(free))), len(mask)) for _ in range(tables)]
    return [tuple(x | y for x, y in zip(mask, m, strict=True)) for m in chosen]


def wide_plan(n: int) -> tuple[int, int]:
    """(bits, blocks) for ``n`` fingerprints: as many bits as leave WIDE_KEY of them under a key, and as many blocks as WIDE_RECALL takes.

    So comparisons of a document don't grow with the corpus but with the number of blocks, as its power 0.24.
    """
    bits = max(WIDE_BITS, math.ceil(math.log2(max(n, 1) / WIDE_KEY)))
    meet = (1 - WIDE_SHARE) ** bits
    return bits, math.ceil(math.log(1 - WIDE_RECALL) / math.log(1 - meet))


def in_blocks(rows: DataFrame, key: str, spread: str, sizes: DataFrame, block: int) -> DataFrame:
    """``rows`` with another key where over ``block`` of them hold one: cut into blocks by a hash of ``spread``, a row goes to each pair of blocks that its own is in.

    ``sizes`` (key, _n) has the number of rows of those keys at least. Any two rows of a key meet again under some key.
    """
    large = sizes.filter(F.col("_n") > block).select(key, F.ceil(F.col("_n") / block).cast("int").alias("_b"))
    n = large.limit(100_001).count()
    if not n:
        return rows
    out = rows.join(F.broadcast(large) if n <= 100_000 else large, key, "left")
    mine = F.pmod(F.xxhash64(spread, F.lit(5)), F.col("_b")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("_b") - 1), lambda j: j != mine)
    keys = F.when(F.col("_b").isNull(), F.array(key)).otherwise(F.transform(others, lambda j: F.xxhash64(key, F.least(mine, j), F.greatest(mine, j))))
    return out.withColumn(key, F.explode(keys)).drop("_b")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(words: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the rows of ``words`` (n, k) that are within the distance; each row is compared with those not yet reached."""
    todo, edges, front = np.arange(1, len(words)), [], [0]
    while True:
        while front and len(todo):
            x = front.pop()
            near = np.bitwise_count(words[todo] ^ words[x]).sum(axis=1, dtype=np.int64) <= distance
            if near.any():
                got = todo[near]
                edges += [(x, int(y)) for y in got]
                front += got.tolist()
                todo = todo[~near]
        if len(todo) < 2:
            return edges
        front, todo = [int(todo[0])], todo[1:]


def similar_forest(words: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the ``sets`` (ascending) that have the Jaccard similarity; ``words`` are their fingerprints."""
    size = np.array([len(s) for s in sets])
    at = np.r_[0, np.cumsum(size)]
    flat = np.concatenate(sets)
    todo, edges, front = np.arange(1, len(sets)), [], [0]
    while True:
        while front and len(todo):
            x = front.pop()
            mine = sets[x]
            may = np.minimum(size[todo], len(mine)) >= similarity * np.maximum(size[todo], len(mine))
            may &= np.bitwise_count(words[todo] ^ words[x]).sum(axis=1, dtype=np.int64) <= WIDE_SURE
            near = todo[may & (size[todo] > 0)]
            got = []
            for part in np.array_split(near, -(-int(size[near].sum()) // GATHER) or 1):
                n = size[part]
                first = np.cumsum(n) - n
                theirs = flat[np.repeat(at[part] - first, n) + np.arange(n.sum())]
                both = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs if len(theirs) else np.zeros(0, bool)
                both = np.add.reduceat(both, first, dtype=np.int64) if len(part) else first
                got += part[both / (n + len(mine) - both) >= similarity].tolist()
            if got:
                edges += [(x, y) for y in got]
                front += got
                todo = todo[~np.isin(todo, got)]
        if len(todo) < 2:
            return edges
        front, todo = [int(todo[0])], todo[1:]


def similar_edges(spark: SparkSession, docs: DataFrame, held: DataFrame, labels: DataFrame, shingle: int) -> DataFrame:
    """(a, b): edges that join, within each label, all fingerprints whose texts' shingle sets have SIMILARITY.

    ``held``: id, f0, ..., and the key _first and text hash _fth of a row that has the fingerprint; ``labels``: (node, label)
    of those that are linked to another. Sets are dealt out by label, so only documents with candidates are compared. Of a
    label with over SET_BLOCK of them, all are first compared with one, HUBS times, wherever they are; those that are like it
    are joined by it, and only the others are compared with all, in blocks.
    """
    names = [f"f{i}" for i in range(WIDE_WORDS)]
    sizes = labels.groupBy("label").agg(F.count("*").alias("_n"))
    large = staged(spark, sizes.filter(F.col("_n") > SET_BLOCK), "large-labels")
    many = large.count()
    near = held.join(labels.withColumnRenamed("node", "id"), "id").select(F.col("_first").alias("_k"), F.col("_fth").alias("_th"), "id", "label", *names)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.concat(*(F.unhex(F.lpad(F.hex(n), 16, "0")) for n in names))
    rows = docs.select(doc_key().alias("_k"), F.xxhash64(text).alias("_th"), text.alias("text")).join(near, ["_k", "_th"]).select("label", "id", words.alias("words"), "text")
    if not many:
        return linked_sets(cut_sets(rows, shingle))
    large = F.broadcast(large) if many <= 100_000 else large
    edges = linked_sets(cut_sets(rows.join(large, "label", "left_anti"), shingle))
    every = staged(spark, cut_sets(rows.join(large, "label", "left_semi"), shingle).dropDuplicates(["id"]), "large-sets")
    rest = every
    for k in range(HUBS):
        hub = rest.groupBy("label").agg(F.min_by(F.struct("id", "words", "sets"), F.struct(F.xxhash64("id", F.lit(k)), "id")).alias("h")).select("label", F.col("h.id").alias("hub"), F.col("h.sets").alias("theirs"))
        hub = staged(spark, hub, "hubs")
        few = hub.count() <= 1000
        found = staged(spark, like_hub(rest.join(F.broadcast(hub) if few else hub, "label")), "like-hubs")
        edges = edges.unionByName(found.filter("a <> b"))
        rest = staged(spark, rest.join(found.select(F.col("a").alias("id")), "id", "left_anti"), "unlike-hubs")
    # what no hub is like: with each other and with all of the label
    left = staged(spark, rest.groupBy("label").agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("_i")).join(every.groupBy("label").agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("_j")), "label"), "unlike-blocks")
    few = left.count() <= 100_000
    left = F.broadcast(left) if few else left
    block = lambda n: F.pmod(F.xxhash64("id", F.lit(6)), F.col(n)).cast("int")
    key = lambda i, j: F.xxhash64("label", i, j)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = rest.join(left, "label").withColumn("_key", F.explode(F.transform(upto("_j"), lambda j: key(block("_i"), j))))
    two = every.join(left, "label").join(rest.select("id"), "id", "left_anti").unionByName(rest.join(left, "label")).withColumn("_key", F.explode(F.transform(upto("_i"), lambda i: key(i, block("_j")))))
    met = one.unionByName(two).select(F.col("_key").alias("label"), "id", "words", "sets")
    return edges.unionByName(linked_sets(met))


def further_edges(spark: SparkSession, docs: DataFrame, held: DataFrame, labels: DataFrame, shingle: int) -> DataFrame:
    """(a, b): all pairs of sets that have SIMILARITY and are in different labels: what the fingerprints have not brought together.

    Exact: such sets share a shingle of their prefixes (``pre``), and so many that the rest can make up the overlap. Shingles of
    one label only go first, then pairs with too few in common; of what is left the sets are compared.
    """
    once = held.select("id", F.explode("pre").alias("g")).withColumn("_c", F.count("*").over(W.partitionBy("g")))
    shared = staged(spark, once.filter("_c > 1").select("g", "id"), "shared-shingles")
    info = held.select("id", "m").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = staged(spark, shared.join(info, "id"), "named-shingles")
    mixed = named.groupBy("g").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo <> _hi").select("g")
    cells = staged(spark, named.join(mixed, "g"), "mixed-shingles")
    side = lambda x: cells.select("g", F.col("id").alias(x), F.col("label").alias(f"_l{x}"), F.col("m").alias(f"_m{x}"))
    fits = F.least("_ma", "_mb") >= SIMILARITY * F.greatest("_ma", "_mb") - 1e-9
    met = side("a").join(side("b"), "g").filter((F.col("a") < F.col("b")) & (F.col("_la") != F.col("_lb")) & fits)
    rest = lambda m: F.ceil(SIMILARITY * F.col(m) - 1e-9) - 1  # noqa: E731  what lies behind the prefix
    need = F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("_ma") + F.col("_mb")) - 1e-9)
    pairs = met.groupBy("a", "b", "_ma", "_mb").agg(F.count("*").alias("_c")).filter(F.col("_c") + F.greatest(rest("_ma"), rest("_mb")) >= need)
    pairs = staged(spark, pairs.select("a", "b"), "further-pairs")
    ids = staged(spark, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(held, "id").select(F.col("_first").alias("_k"), F.col("_fth").alias("_th"), "id"), "further-ids")
    few = ids.limit(100_001).count() <= 100_000
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(doc_key().alias("_k"), F.xxhash64(text).alias("_th"), text.alias("text")).join(F.broadcast(ids) if few else ids, ["_k", "_th"])
    sets = cut_sets(rows.select(F.lit(0).cast("long").alias("label"), "id", F.lit(b"").alias("words"), "text"), shingle).select("id", "sets")
    sets = staged(spark, sets.dropDuplicates(["id"]), "further-sets")
    both = pairs.withColumnsRenamed({"a": "id", "b": "hub"}).join(sets, "id").join(sets.select(F.col("id").alias("hub"), F.col("sets").alias("theirs")), "hub")
    return staged(spark, like_hub(both), "further-edges")


def cut_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(label, id, words, sets) of rows (label, id, words, text): the ascending hashes of a text's shingles, as bytes."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            # repeated rows have one id
            b = b.take(pa.array(np.sort(np.unique(b.column(1).to_numpy(), return_index=True)[1])))
            for x, y, texts in text_slices(b.column(3)):
                sets = [s.astype("<u8").tobytes() for s in shingle_sets(texts, shingle)]
                yield pa.RecordBatch.from_arrays([*(c.slice(x, y - x) for c in b.columns[:3]), pa.array(sets, pa.binary())], names=["label", "id", "words", "sets"])
        release_memory()

    return rows.mapInArrow(cut, "label long, id long, words binary, sets binary")


def like_hub(rows: DataFrame) -> DataFrame:
    """(a, b): id and hub of those rows (id, sets, hub, theirs, ...) whose sets have SIMILARITY; the hub itself is among them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for ident, mine, hub, theirs in zip(*(b.column(c).to_pylist() for c in ("id", "sets", "hub", "theirs")), strict=True):
                x, y = np.frombuffer(mine, "<u8"), np.frombuffer(theirs, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                if ident == hub or both and both / (len(x) + len(y) - both) >= SIMILARITY:
                    out.append((ident, hub))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        release_memory()

    return rows.select("id", "sets", "hub", "theirs").mapInArrow(run, "a long, b long")


def linked_sets(sets: DataFrame) -> DataFrame:
    """(a, b): edges of a spanning forest of those sets that have SIMILARITY, within each label. ``sets``: (label, id, words, sets)."""

    def link(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def solve(rows: dict[int, tuple[bytes, bytes]]):
            ids = list(rows)
            fps = np.frombuffer(b"".join(r[0] for r in rows.values()), ">u8").astype(np.uint64).reshape(len(ids), -1)
            return [(ids[x], ids[y]) for x, y in similar_forest(fps, [np.frombuffer(r[1], "<u8") for r in rows.values()])]

        now, rows, found = None, {}, []
        for b in batches:
            for label, ident, fp, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if label != now:
                    found += solve(rows) if len(rows) > 1 else []
                    now, rows = label, {}
                rows[ident] = (fp, held)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
                found = []
        found = solve(rows) if len(rows) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
        release_memory()

    return sets.repartition("label").sortWithinPartitions("label").mapInArrow(link, "a long, b long")


def link_sorted(rows: DataFrame, distance: int) -> DataFrame:
    """(a, b): edges that join all rows within the distance under each key. ``rows``: key long, id long, words binary.

    Rows are dealt out by key and sorted, and a worker goes through runs of equal keys. Only forests leave it.
    """
    rows = rows.repartition("key").sortWithinPartitions("key").select("key", "id", "words")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def link(keys, ids, words) -> list[tuple[int, int]]:
            edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            size = np.diff(edge)
            twos = edge[:-1][size == 2]
            near = np.bitwise_count(words[twos] ^ words[twos + 1]).sum(axis=1, dtype=np.int64) <= distance
            out = list(zip(ids[twos[near]].tolist(), ids[twos[near] + 1].tolist(), strict=True))
            for a, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                out += [(int(ids[a + x]), int(ids[a + y])) for x, y in forest(words[a : a + n], distance)]
            return out

        held = None
        for b in batches:
            if not len(b):
                continue
            words = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(len(b), -1)
            now = (b.column(0).to_numpy(), b.column(1).to_numpy(), words)
            held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            cut = int(np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]])[-1])
            found = link(*(x[:cut] for x in held)) if cut else []
            held = tuple(x[cut:] for x in held)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
        if held is not None and (found := link(*held)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
        release_memory()

    return rows.mapInArrow(run, "a long, b long")


def hamming_edges(spark: SparkSession, fps: DataFrame, width: int, distance: int, first: Masks, split: Callable[[tuple[int, ...]], Masks], max_bucket: int = MAX_BUCKET, levels: int = MAX_LEVELS) -> DataFrame:
    """(a, b): edges between ids of ``fps`` (id, f0, ...: different fingerprints) within the distance that share a key.

    A fingerprint goes to the key that each mask makes of it. Keys with over ``max_bucket`` fingerprints are split by the
    longer masks that ``split`` gives, until there are ``levels`` levels; one level splits none. Where keys are not split any
    further, those with over KEY_BLOCK fingerprints are compared in blocks. Of each key only a spanning forest leaves the
    worker. Only the number of large keys comes to the driver.
    """
    names = [f"f{i}" for i in range(width)]
    rows = fps.select("id", *names, F.lit(0).alias("path"), F.lit(0).cast("long").alias("key"))
    paths, found = [first], None
    for level in range(1, levels + 1):
        fan = len(paths[0])
        masks = [m for more in paths for m in more]
        table = [F.array(*(F.lit(_signed(m[i])).cast("long") for m in masks)) for i in range(width)]
        rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(fan - 1)))).withColumn("path", F.col("path") * fan + F.col("_j"))
        masked = [F.col(n).bitwiseAND(F.get(t, F.col("path"))) for n, t in zip(names, table, strict=True)]
        rows = rows.select("id", *names, "path", F.xxhash64("path", *masked).alias("key"))
        large = None
        if level < levels:
            large = staged(spark, rows.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > max_bucket).select("key"), "large-keys")
            n = large.count()
            large = None if not n else F.broadcast(large) if n <= 100_000 else large
        here = rows if large is None else rows.join(large, "key", "left_anti")
        words = F.concat(*(F.unhex(F.lpad(F.hex(n), 16, "0")) for n in names))
        met = here.select("key", "id", words.alias("words"))
        if large is None and level == levels:
            sizes = staged(spark, here.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > KEY_BLOCK), "key-sizes")
            met = in_blocks(met, "key", "id", sizes, KEY_BLOCK)
        links = link_sorted(met, distance)
        found = links if found is None else found.unionByName(links)
        if large is None:
            break
        rows = rows.join(large, "key", "left_semi")
        paths = [split(m) for m in masks]
    return found


def groups(spark: SparkSession, docs: DataFrame, shingle: int = 3, distance: int = 3, wide: bool = False, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(_k, _th, doc_id, f0, ..., component) of every row of ``docs``; component is the smallest document key reachable by links, its own included.

    Fingerprints that differ in ``distance`` bits at most are linked; wide ones only if the shingle sets have SIMILARITY,
    too, and so are all other sets that have it. Equal ones (wide: equal sets) are one node, so copies are never expanded into pairs. A null or empty text, or one without words, has fingerprint 0 and is linked like any other. A null doc_id
    counts as the largest. Repeated rows all come back. An empty table gives no rows. Other columns play no part.
    """
    width = WIDE_WORDS if wide else 1
    names = [f"f{i}" for i in range(width)]
    fps = staged(spark, fingerprints(docs, shingle, wide), "fingerprints")
    nodes = ["_set", *names] if wide else names
    ident = F.col(nodes[0])
    more = [F.first("m").alias("m"), F.first("pre").alias("pre")] if wide else []
    held = fps.groupBy(*nodes).agg(F.min("_k").alias("_first"), F.min(F.struct("_k", "_th"))["_th"].alias("_fth"), F.count("*").alias("_n"), *more).withColumn("id", ident)
    held = staged(spark, held, "held")
    fps = fps.drop("m", "pre")
    none = (0,) * width
    if wide:
        bits, tables = wide_plan(held.count())
        edges = hamming_edges(spark, held, width, distance, random_masks(none, tables, bits), lambda m: [], max_bucket, levels=1)
    else:
        edges = hamming_edges(spark, held, width, distance, pigeonhole_masks(none, distance), lambda m: pigeonhole_masks(m, distance), max_bucket)
    labels = components(spark, edges)
    if wide:
        labels = components(spark, similar_edges(spark, docs, held, labels, shingle))
        labels = components(spark, labels.toDF("a", "b").unionByName(further_edges(spark, docs, held, labels, shingle)))
        held = held.drop("m", "pre")
    held = staged(spark, held.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")
    least = staged(spark, held.groupBy("label").agg(F.min("_first").alias("component"), F.count("*").alias("_held")), "components")
    held = staged(spark, skew_safe_lookup(held, least, ["label"], ["component"], "_held", ["id"]), "held-components")
    return skew_safe_lookup(fps, held, nodes, ["component"], "_n", ["_k", "_th"]).drop("_set")


def near_groups(spark: SparkSession, docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component) of every row: :func:`groups` with 64-bit fingerprints; a component of rows without ids has a null id."""
    out = groups(spark, docs, shingle, distance)
    return out.select("doc_id", F.col("f0").alias("fp"), from_doc_key(F.col("component")).alias("component"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near copies: that of the smallest doc_id, with all columns as they are.

    Near copies share shingles of ``shingle`` words to a Jaccard similarity of 0.8 or more, and so do all that links a
    group: wide fingerprints find the candidates, the sets are compared. See :func:`groups` for nulls and ties. Of rows with equal id and text one stays; of rows with one id and different texts in
    one group, that whose text has the least hash.
    """
    found = staged(spark, groups(spark, docs, shingle, WIDE_DISTANCE, wide=True).select("_k", "_th", "component"), "groups")
    best = found.filter(F.col("_k") == F.col("component")).groupBy("component").agg(F.min("_th").alias("_th"))
    keep = best.select(F.col("component").alias("_k"), "_th")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the input's columns travel in a struct, whatever their names
    rows = docs.select(doc_key().alias("_k"), F.xxhash64(text).alias("_th"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")).join(keep, ["_k", "_th"], "left_semi")
    again = found.groupBy("_k", "_th").count().filter("count > 1").limit(1).count()
    rows = rows.dropDuplicates(["_k", "_th"]) if again else rows
    return rows.select("_row.*")
