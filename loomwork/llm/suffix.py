"""Suffix-array dedup: a byte goes if a string of WINDOW bytes that covers it also starts anywhere else.

Suffixes are sorted with the difference-cover algorithm (DC3): sampled triples are sorted and named, names are sorted by
recursion, the other suffixes are merged in, and adjacent prefixes are compared. To sort only what can matter, and to sort
it in independent parts, the text is first cut up by content: the anchor of a window is its k-gram of least hash, so equal
windows have equal anchors at equal places. Successive windows with one anchor are a unit; its context is their text.

- An anchor that occurs once has no repeated window.
- Units with equal contexts are repeated as a whole.
- What is left, different contexts of one anchor, is dealt out by anchor, and their suffixes are sorted.
- An anchor with very many different contexts, or too many bytes of them for one sort, is dealt out by window instead,
  and equal windows are counted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomwork.llm.common import doc_key, skew_safe_lookup, staged
from loomwork.llm.difference_cover import repeated_offsets
from loomwork.llm.textkit import as_bytes, mix, release_memory, spans_hash, text_slices

WINDOW = 400
GRAM = 32
#: Bytes of contexts whose suffixes are sorted at once; one anchor's contexts are never parted.
SORT_BYTES = 1 << 19
#: Different contexts of one anchor beyond which its windows are dealt out and counted.
MAX_CONTEXTS = 1 << 15
#: Bytes of one anchor's different contexts, separators included, beyond which its windows are dealt out and counted, too.
#: With SORT_BYTES of other anchors before them, one sort is of fewer than 2**21 bytes.
MAX_BYTES = (1 << 21) - SORT_BYTES - (1 << 17)
#: Bits of the bitmaps by which the second pass over the texts knows the units that it must hand on.
ANCHOR_BITS = 25
_KEY_BITS = 21


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 of the keys, equal for equal keys, and their number."""
    values, names = np.unique(keys, return_inverse=True)
    return names + 1, len(values)


def _pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks of the pairs; both parts below 2**31."""
    return _names(high << 32 | low)[0]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` (positive numbers below 2**31, fewer than 2**31) in ascending order, by DC3.

    Triples of numbers below 2**_KEY_BITS are compared as one key; of larger ones, two are first replaced by their rank.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.r_[np.asarray(s, np.int64), 0, 0, 0]
    sample = np.r_[np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)]
    fits = max(int(s.max()), len(sample)) < 1 << _KEY_BITS
    if fits:
        names, kinds = _names(s[sample] << 2 * _KEY_BITS | s[sample + 1] << _KEY_BITS | s[sample + 2])
    else:
        names, kinds = _names(_pairs(s[sample], s[sample + 1]) << 32 | s[sample + 2])
    if kinds < len(sample):
        order = suffix_array(names)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    sample = sample[np.argsort(names, kind="stable")]
    sample = sample[sample < n]
    rest = np.arange(0, n, 3)
    key = s[rest] << 32 | rank[rest + 1]
    order = np.argsort(key, kind="stable")
    rest, key = rest[order], key[order]
    ones, twos = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(s[ones] << 32 | rank[ones + 1], key)
    if fits:
        wide = lambda i: s[i] << 2 * _KEY_BITS | s[i + 1] << _KEY_BITS | rank[i + 2]
        before += np.searchsorted(wide(twos), wide(rest))
    else:
        both = np.r_[twos, rest]
        wide = _pairs(s[both], s[both + 1]) << 32 | rank[both + 2]
        before += np.searchsorted(wide[: len(twos)], wide[len(twos) :])
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + before
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sample
    return out


def repeated_starts(text: bytes, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of the starts (each with ``window`` bytes after it) begin with the same window as another of them."""
    buf = np.frombuffer(text, np.uint8)
    order = suffix_array(buf.astype(np.int64) + 1)
    wanted = np.zeros(len(buf), bool)
    wanted[starts] = True
    order = order[wanted[order]]
    hashes = spans_hash(buf, order, order + window)
    same = np.flatnonzero(hashes[1:] == hashes[:-1])
    if len(same):
        views = np.lib.stride_tricks.sliding_window_view(buf, window)
        same = np.concatenate([p[(views[order[p]] == views[order[p + 1]]).all(axis=1)] for p in np.array_split(same, -(-len(same) // 4096))])
    hit = np.zeros(len(buf), bool)
    hit[order[same]] = hit[order[same + 1]] = True
    return hit[starts]


class Units:
    """Units of some texts: ``text`` number, ``start`` in the text, number of ``windows``, ``anchor`` and ``context`` hashes."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
        joined = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(joined, np.uint8)
        at = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)]
        n = len(buf) - window + 1
        self.text = self.start = self.windows = self.anchor = self.context = np.zeros(0, np.int64)
        if n <= 0:
            return
        grams = np.arange(len(buf) - gram + 1)
        hashes = spans_hash(buf, grams, grams + gram)
        low = np.uint64((1 << 32) - 1)
        least = _window_min(hashes & ~low | grams.astype(np.uint64), window - gram + 1)[:n]
        anchor = (least & low).astype(np.int64)
        text = np.searchsorted(at, np.arange(n), "right") - 1
        inside = np.arange(n) + window < at[text + 1]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]] & inside
        first = np.flatnonzero(new)
        self.windows = np.add.reduceat(inside.astype(np.int64), first) if len(first) else first
        self.text, self.start, self.anchor = text[first], first - at[text[first]], hashes[anchor[first]]
        self.first, self.buf = first, buf
        self.context = spans_hash(buf, first, first + self.windows + window - 1)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each run of w successive values, by minima from block edges forwards and backwards."""
    n = len(x)
    padded = np.r_[x, np.full(-n % w + w, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, w)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans; spans that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]] if len(starts) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return starts[first], ends[np.r_[first[1:], len(starts)] - 1] if len(first) else ends


def _bitmap(keys: DataFrame) -> bytes:
    """Bitmap of the top bits of a column of hashes, compressed; of a fixed size, so full ones tell less but nothing is lost.

    A task makes one, sixteen groups of them are put together by workers, and those come to the driver.
    """

    def one(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        bits = np.zeros(1 << ANCHOR_BITS, bool)
        for b in batches:
            bits[b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - ANCHOR_BITS)] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)])], names=["g", "bits"])

    def both(blobs: list[bytes]) -> bytes:
        out = np.zeros(1 << ANCHOR_BITS - 3, np.uint8)
        for x in blobs:
            out |= np.frombuffer(zlib.decompress(x), np.uint8)
        return zlib.compress(out.tobytes(), 1)

    def group(table):
        import pyarrow as pa

        return pa.table({"g": table.column("g")[:1], "bits": pa.array([both(table.column("bits").to_pylist())], pa.binary())})

    made = keys.mapInArrow(one, "g int, bits binary").groupBy("g").applyInArrow(group, "g int, bits binary")
    return both([r.bits for r in made.select("bits").collect()])


def runs(spans: DataFrame) -> DataFrame:
    """``spans`` (_k, _th, start, end) of one length each, those of a text that touch put together."""
    order = W.partitionBy("_k", "_th").orderBy("start")
    new = F.when(F.col("start") > F.lag("end").over(order), 1).otherwise(0)
    counted = spans.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return counted.groupBy("_k", "_th", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def find_spans(spark: SparkSession, docs: DataFrame, window: int = WINDOW, max_contexts: int = MAX_CONTEXTS, max_bytes: int = MAX_BYTES, distributed: bool = False) -> DataFrame:
    """(_k, _th, start, end): byte spans of repeated windows of each text, by document key and hash of the text; they may overlap.

    ``distributed``: the suffixes of all different contexts of repeated anchors are ranked together, by
    :func:`loomwork.llm.difference_cover.suffix_ranks`, instead of an anchor's in one worker.
    """
    if distributed:
        max_contexts = max_bytes = 1 << 62
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(doc_key().alias("_k"), F.xxhash64(text).alias("_th"), text.alias("text"))
    gram = min(GRAM, window)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for x, _, texts in text_slices(b.column(2)):
                u = Units(texts, window, gram)
                which = pa.array(u.text + x)
                yield pa.RecordBatch.from_arrays([b.column(0).take(which), b.column(1).take(which), pa.array(u.start), pa.array(u.windows), pa.array(u.anchor.view(np.int64)), pa.array(u.context.view(np.int64))], names=names)
        release_memory()

    names = ["_k", "_th", "start", "windows", "anchor", "context"]
    units = staged(spark, rows.mapInArrow(cut, ", ".join(f"{n} long" for n in names)), "units")
    anchors = staged(spark, units.groupBy("anchor").agg(F.count("*").alias("_n")).filter("_n > 1").withColumn("_yes", F.lit(1)), "anchors")
    units = skew_safe_lookup(units, anchors, ["anchor"], ["_yes"], "_n", ["_k", "_th", "start"]).filter("_yes = 1").drop("_yes")
    units = staged(spark, units, "repeated-units")
    row = F.xxhash64("_k", "_th")
    contexts = staged(spark, units.groupBy("anchor", "context").agg(F.count("*").alias("_n"), F.min(row).alias("_row"), (F.max("windows") + window).alias("_bytes")), "contexts")
    copied = contexts.filter("_n > 1").withColumn("_yes", F.lit(1))
    whole = skew_safe_lookup(units, copied, ["anchor", "context"], ["_yes"], "_n", ["_k", "_th", "start"]).filter("_yes = 1")
    whole = whole.select("_k", "_th", "start", (F.col("start") + F.col("windows") + (window - 1)).alias("end"))
    mixed = staged(spark, contexts.groupBy("anchor").agg(F.count("*").alias("_n"), F.sum("_bytes").alias("_bytes")).filter("_n > 1").withColumn("_yes", F.lit(1)), "mixed")
    many_contexts = (F.col("_n") > max_contexts) | (F.col("_bytes") > max_bytes)
    # one unit stands for all with its context: that of one text
    wanted = skew_safe_lookup(contexts, mixed.filter(~many_contexts), ["anchor"], ["_yes"], "_n", ["context"]).filter("_yes = 1")
    wanted = wanted.select(F.col("_row").bitwiseXOR(F.col("context")).alias("key"))
    bits = spark.sparkContext.broadcast((_bitmap(wanted), _bitmap(mixed.filter(many_contexts).select("anchor"))))
    rows = rows.select("_k", "_th", "text", row.alias("_row"))

    def fetch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        some, many = (np.unpackbits(np.frombuffer(zlib.decompress(x), np.uint8)).astype(bool) for x in bits.value)
        top = np.uint64(64 - ANCHOR_BITS)
        for b in batches:
            for x, _, texts in text_slices(b.column(2)):
                u = Units(texts, window, gram)
                if not len(u.text):
                    continue
                large = many[u.anchor >> top]
                own = b.column(3).to_numpy()[u.text + x].view(np.uint64)
                sort = np.flatnonzero(some[(own ^ u.context) >> top] & ~large)
                # one of several equal contexts in this slice stands for all: those are repeated as a whole
                sort = sort[np.unique(mix(u.anchor[sort]) + u.context[sort], return_index=True)[1]]
                keys, where, starts, counts = [u.anchor[sort]], [u.text[sort]], [u.start[sort]], [u.windows[sort]]
                data = [u.buf[a : a + n + window - 1].tobytes() for a, n in zip(u.first[sort].tolist(), u.windows[sort].tolist(), strict=True)]
                for i in np.flatnonzero(large):
                    n = int(u.windows[i])
                    at = u.first[i] + np.arange(n)
                    keys.append(spans_hash(u.buf[u.first[i] : u.first[i] + n + window], at - u.first[i], at - u.first[i] + window))
                    where.append(np.full(n, u.text[i]))
                    starts.append(u.start[i] + np.arange(n))
                    counts.append(np.ones(n, np.int64))
                    data += [None] * n
                which = pa.array(np.concatenate(where) + x)
                step = 4096
                cols = [b.column(0).take(which), b.column(1).take(which), pa.array(np.concatenate(starts)), pa.array(np.concatenate(counts)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(data, pa.binary())]
                for a in range(0, len(which), step):
                    yield pa.RecordBatch.from_arrays([c.slice(a, step) for c in cols], names=["_k", "_th", "start", "windows", "key", "data"])
        release_memory()

    fetched = rows.mapInArrow(fetch, "_k long, _th long, start long, windows long, key long, data binary")
    if distributed:
        texts = staged(spark, fetched.withColumn("c", F.xxhash64("key", "data")).dropDuplicates(["c"]), "different-contexts")
        hits = repeated_offsets(spark, texts.select(F.col("c").alias("k"), F.col("data").alias("text")), window)
        at = F.col("start") + F.col("offset")
        return whole.unionByName(runs(texts.select(F.col("c").alias("k"), "_k", "_th", "start").join(hits, "k").select("_k", "_th", at.alias("start"), (at + window).alias("end"))))
    has_large = mixed.filter(many_contexts).limit(1).count() > 0
    if has_large:
        fetched = staged(spark, fetched, "fetched")

    def sort(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def solve(group: list[tuple]) -> list[tuple[int, int, int, int]]:
            group = list({(g[4], g[5]): g for g in group}.values())
            text = b"\n".join(g[5] for g in group)
            first = np.cumsum([0, *(len(g[5]) + 1 for g in group)])[:-1]
            counts = np.array([g[3] for g in group])
            base = np.cumsum(counts) - counts
            owner = np.repeat(np.arange(len(group)), counts)
            inner = np.arange(len(owner)) - base[owner]
            hit = repeated_starts(text, first[owner] + inner, window)
            out = []
            for g in np.unique(owner[hit]).tolist():
                k, th, start = group[g][:3]
                mine = start + np.flatnonzero(hit[base[g] : base[g] + counts[g]])
                out += [(k, th, int(a), int(b)) for a, b in zip(*merged(mine, mine + window), strict=True)]
            return out

        def batch(found: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["_k", "_th", "start", "end"])

        done: list[tuple] = []  # whole anchors with more than one context
        now: list[tuple] = []
        held = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now and now[0][4] != row[4]:
                    if len(now) > 1:
                        done += now
                        held += sum(len(r[5]) for r in now)
                    now = []
                    if held >= SORT_BYTES:
                        if found := solve(done):
                            yield batch(found)
                        done, held = [], 0
                now.append(row)
        done += now if len(now) > 1 else []
        if done and (found := solve(done)):
            yield batch(found)
        release_memory()

    out = whole.unionByName(fetched.filter("data IS NOT NULL").repartition("key").sortWithinPartitions("key").mapInArrow(sort, "_k long, _th long, start long, end long"))
    if has_large:
        single = fetched.filter("data IS NULL").select("_k", "_th", "start", "key")
        twice = staged(spark, single.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").withColumn("_yes", F.lit(1)), "twice")
        found = skew_safe_lookup(single, twice, ["key"], ["_yes"], "_n", ["_k", "_th", "start"]).filter("_yes = 1")
        out = out.unionByName(runs(found.select("_k", "_th", "start", (F.col("start") + window).alias("end"))))
    return out


def drop_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, max_contexts: int = MAX_CONTEXTS, distributed: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of each row: spans are the maximal runs removed, kept the bytes left (binary).

    A byte goes if a string of ``window`` bytes that covers it starts at another place too, in any document, the same
    included; all of them go. Texts are UTF-8 bytes, a null text is empty; matches never cross documents. Texts shorter than
    the window stay whole. Repeated rows repeat each other's strings and all come back. An empty table gives no rows. Other
    columns play no part. ``distributed``: see :func:`find_spans`; the results are the same.
    """
    spans = find_spans(spark, docs, window, max_contexts, distributed=distributed).groupBy("_k", "_th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", doc_key().alias("_k"), F.xxhash64(text).alias("_th"), text.alias("text")).join(spans, ["_k", "_th"], "left")
    kind = docs.schema["doc_id"].dataType
    one = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(one)), T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for a in range(0, len(b), 256):
                part = b.slice(a, 256)
                texts = as_bytes(part.column(1))
                runs, kept = [], []
                for text, found in zip(texts, part.column(2).to_pylist(), strict=True):
                    starts, ends = merged(*(np.array([s[k] for s in found or []], np.int64) for k in ("start", "end")))
                    runs.append([{"start": int(x), "end": int(y)} for x, y in zip(starts, ends, strict=True)])
                    edges = [0, *(e for r in runs[-1] for e in (r["start"], r["end"])), len(text)]
                    kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                sizes = [len(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array([n - len(k) for n, k in zip(sizes, kept, strict=True)], pa.int64()), pa.array(runs, arrow), pa.array(kept, pa.binary())], names=schema.names)

    return rows.select("doc_id", "text", "spans").mapInArrow(cut, schema)
