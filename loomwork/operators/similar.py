"""Similarity joins of texts by the Jaccard similarity of their character n-gram sets: exact, every link is found.

Two sets of a and b grams that reach the threshold t differ in d = (1 - t) / (1 + t) * (a + b) grams at most. Grams are dealt
to more than d parts by hash, so some parts are equal; what a text has in a part is hashed to a signature. By the cycle lemma
at least (parts - d) of the equal parts start a run in which the first l parts differ in l - 1 grams at most, for every l.
So texts meet where signatures are equal, and a meeting counts if the parities of the next parts (eight bits each, which never
differ in more bits than the parts in grams) keep to that. There are a tenth more parts than needed, so a pair that reaches the
threshold has as many meetings to show; a text leaves out its smallest parts, as many as leave it those. Parts are counted by
classes of size, a text goes to those classes in which a larger partner may be. A class is dealt to some groups by signature; in
one of them a pair has its share of the meetings at least. What has is compared by whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.joins import small_enough
from loomwork.operators.store import stored

#: Ratio of the sizes of a class; parts for each gram in which sets may differ.
RATIO, PARTS = 1.6, 1.1
#: Signatures of a worker that are sent out at once, and signatures of all classes for each group of a class.
FLUSH, GROUP = 1 << 20, 12 << 20
#: Groups of a class at least, and pairs that are compared in one group, about.
GROUPS, PAIRS = 4, 2000
#: Keys of texts that may be broadcast.
KEYS = 1_000_000
MULTIPLIER, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SENT = ("k", "t", "side", "n", "sig", "sketch")


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * MIXER
    return h ^ (h >> np.uint64(32))


def gram_hashes(text: str, n: int) -> np.ndarray:
    """The set of the text's n-grams by 64-bit hashes, ascending; a text of up to n code points is its own."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    k = max(1, len(c) - n + 1)
    h = np.zeros(k, np.uint64)
    for i in range(min(n, len(c))):
        h = h * MULTIPLIER + c[i : i + k]
    h = _mixed(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


@lru_cache(maxsize=1 << 14)
def _classes(m: int, threshold: float) -> list[tuple[int, int, int, int]]:
    """(class, parts, parts to keep, meetings of a pair at least) where a set of m grams may meet one of its size or more."""
    share, largest, out, c = (1 - threshold) / (1 + threshold), int(m / threshold + 1e-6), [], 0
    while True:
        low, high = int(np.ceil(RATIO**c)), int(np.ceil(RATIO ** (c + 1))) - 1
        if low > largest:
            return out
        if m <= high:
            most = int(share * 2 * high + 1e-6)
            parts = int(PARTS * most) + 1
            need = parts - most
            out.append((c, parts, min(parts, int(share * (m + min(high, largest)) + 1e-6) + need), need))
        c += 1


def signatures(grams: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each class: its number, signatures of a set, and for each of these the parities of the four parts after it."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(grams + MIXER))])
    flips = np.concatenate([np.zeros(1, np.uint8), np.bitwise_xor.accumulate(np.left_shift(1, (grams & np.uint64(7)).astype(np.uint8), dtype=np.uint8))])
    place = grams >> np.uint64(32)
    for c, parts, keep, _ in _classes(len(grams), threshold):
        ends = np.searchsorted(place * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
        held = np.diff(ends)
        sig = _mixed(np.diff(sums[ends]) + np.arange(parts, dtype=np.uint64) * MULTIPLIER + np.uint64(c * int(MIXER) % (1 << 64)))
        bits = flips[ends[1:]] ^ flips[ends[:-1]]
        sketch = np.zeros(parts, np.uint32)
        for i in range(1, 5):
            if i < parts:  # a run is no longer than all parts
                sketch |= np.roll(bits, -i).astype(np.uint32) << np.uint32(8 * (i - 1))
        if keep < parts:
            smallest = (np.uint64(255) - np.minimum(held, 255).astype(np.uint64) << np.uint64(56)) + (sig >> np.uint64(8))
            kept = np.argpartition(smallest, keep - 1)[:keep]
            sig, sketch = sig[kept], sketch[kept]
        yield c, sig, sketch


def _texts(column: pa.ChunkedArray) -> Iterator[str]:
    for x in column.cast(pa.binary()):
        yield x.as_py().decode("utf-8", "replace")


def _send(threshold: float, n: int, groups: int):
    """Rows (t, side, x) to rows of signatures by group: as many texts at once as make FLUSH signatures, a row for each group."""

    def packed(rows: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        t, side = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.uint8)
        of = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
        sig, sketch = np.concatenate([r[3] for r in rows]), np.concatenate([r[4] for r in rows])
        group = (sig % np.uint64(groups)).astype(np.int32) + np.repeat([r[2] * groups for r in rows], [len(r[3]) for r in rows]).astype(np.int32)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(group.max() + 2))
        out: list[list] = [[] for _ in SENT]
        for k in np.flatnonzero(np.diff(cuts)):
            here = order[cuts[k] : cuts[k + 1]]
            who, held = np.unique(of[here], return_counts=True)
            low = (sig[here] // np.uint64(groups)).astype(np.uint32)
            for to, x in zip(out, (int(k), t[who].tobytes(), side[who].tobytes(), held.astype(np.uint32).tobytes(), low.tobytes(), sketch[here].tobytes()), strict=True):
                to.append(x)
        return pa.record_batch([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=list(SENT))

    def run(batches):
        rows, held, seen = [], 0, set()
        for batch in batches:
            for t, side, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2)), strict=True):
                if (t, side) in seen:
                    continue
                seen.add((t, side))
                for c, sig, sketch in signatures(gram_hashes(x, n), threshold):
                    rows.append((t, side, c, sig, sketch))
                    held += len(sig)
                if held >= FLUSH:
                    yield packed(rows)
                    rows, held, seen = [], 0, set()
        if rows:
            yield packed(rows)

    return run


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    keys, counts = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return [(keys[first], np.add.reduceat(counts, first).astype(np.int32))] if len(keys) else [(keys, counts)]


def _meet(threshold: float, groups: int):
    """Pairs of a group's texts with their share of the meetings that their class takes; a of side 1 and b of side 2, or a < b of side 3."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])
        c = key[0].as_py() // groups
        need = next(need for k, _, _, need in _classes(int(np.ceil(RATIO**c)), threshold) if k == c)
        n, sig = read("n", np.uint32), read("sig", np.uint32)
        keys, which = np.unique(read("t", np.int64), return_inverse=True)
        order = np.argsort(sig)
        same = sig[order][1:] == sig[order][:-1]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]  # signatures of one text meet nothing
        of, side, sketch = np.repeat(which.astype(np.int32), n)[order], np.repeat(read("side", np.uint8), n)[order], read("sketch", np.uint32)[order]
        sig = sig[order]
        order = np.lexsort((side, of, sig))
        sig, of, side, sketch = sig[order], of[order], side[order], sketch[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (of[1:] != of[:-1]) | (side[1:] != side[:-1]) | (sketch[1:] != sketch[:-1])
        sig, of, side, sketch = sig[new], of[new], side[new], sketch[new]
        i, found, held = np.arange(len(sig)), [(np.zeros(0, np.int64), np.zeros(0, np.int32))], 0
        for step in range(1, len(sig)):
            i = i[i + step < len(sig)]
            i = i[sig[i] == sig[i + step]]
            if not len(i):
                break
            x = sketch[i] ^ sketch[i + step]
            near = np.ones(len(i), bool)
            for l in range(1, 5):  # noqa: E741
                near &= np.bitwise_count(x & np.uint32((1 << 8 * l) - 1)) <= l
            p = i[near]
            for a, b in ((p, p + step), (p + step, p)):
                ok = (side[a] & 1 > 0) & (side[b] & 2 > 0) & ((of[a] < of[b]) | (side[a] != 3) & (of[a] != of[b]))
                found.append((of[a][ok].astype(np.int64) * len(keys) + of[b][ok], np.ones(int(ok.sum()), np.int32)))
                held += len(found[-1][0])
            if held > 1 << 20:
                found, held = _summed(found), 0
        pairs, met = _summed(found)[0]
        pairs = pairs[met >= -(-need // groups)]
        return pa.table({"at": keys[pairs // len(keys)], "bt": keys[pairs % len(keys)]})

    return run


def _compare(threshold: float, n: int):
    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        sets = {}
        for t, x in zip(texts.column("t").to_pylist(), _texts(texts.column("x")), strict=True):
            if t not in sets:
                sets[t] = (len(x), gram_hashes(x, n))
        out: list[tuple] = []
        for a, b in zip(pairs.column("at").to_pylist(), pairs.column("bt").to_pylist(), strict=True):
            (al, ag), (bl, bg) = sets[a], sets[b]
            if min(len(ag), len(bg)) >= threshold * max(len(ag), len(bg)):
                both = np.concatenate([ag, bg])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if (j := common / (len(both) - common)) >= threshold:
                    out.append((a, al, b, bl, j))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64())
        cols = zip(*out, strict=True) if out else [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["at", "al", "bt", "bl", "jaccard"])

    return run


def similar(rows: DataFrame, threshold: float, n: int) -> DataFrame:
    """(at, al, bt, bl, jaccard) of all pairs of different texts of ``rows`` (t long, side int, x string) whose gram sets reach the threshold.

    t stands for the text x, which may come in several rows; al and bl are code points. Side 1 pairs with side 2, a text of
    side 1 as a; rows of side 3 pair with each other, the lesser t as a. Null texts pair with nothing.
    """
    rows = rows.filter("x IS NOT NULL")
    chars = rows.agg(F.sum(F.length("x"))).first()[0] or 0
    groups = max(GROUPS, int(0.2 * chars / GROUP) + 1)
    sent = rows.select("t", "side", "x").mapInArrow(_send(threshold, n, groups), ", ".join(f"{c} {'int' if c == 'k' else 'binary'}" for c in SENT))
    pairs = stored(sent.groupBy("k").applyInArrow(_meet(threshold, groups), "at long, bt long").distinct())
    total = pairs.count()
    # pairs of one least neighbour are compared together, so that a text goes to few groups; a crowd's are dealt to squares
    ends = pairs.select(F.col("at").alias("t"), F.col("bt").alias("o")).unionByName(pairs.select(F.col("bt").alias("t"), F.col("at").alias("o")))
    least = ends.groupBy("t").agg(F.least(F.min("o"), F.first("t")).alias("h"))
    parts = least.groupBy("h").agg(F.ceil(F.count("*") / F.lit(PAIRS / 4)).alias("s"))
    least = stored(least.join(parts, "h").select("t", F.struct("h", F.pmod(F.xxhash64("t"), F.col("s")).alias("s")).alias("h")))
    key = F.pmod(F.xxhash64("ah", "bh"), F.lit(total // PAIRS + 1)).cast("int")
    pairs = pairs.join(least.select(F.col("t").alias("at"), F.col("h").alias("ah")), "at").join(least.select(F.col("t").alias("bt"), F.col("h").alias("bh")), "bt")
    pairs = stored(pairs.select(key.alias("k"), "at", "bt"))
    goes = pairs.select("k", F.explode(F.array("at", "bt")).alias("t")).groupBy("t").agg(F.collect_set("k").alias("ks"))
    copies = rows.groupBy("t").agg((F.count("*") > 1).alias("copies"))
    goes = stored(goes.join(copies, "t"))
    found = rows.select("t", "x").join(F.broadcast(goes) if small_enough(goes, KEYS) else goes, "t")
    once = found.filter("copies").groupBy("t").agg(F.first("x").alias("x"), F.first("ks").alias("ks"))
    texts = found.filter("NOT copies").select("t", "x", "ks").unionByName(once).select(F.explode("ks").alias("k"), "t", "x")
    return pairs.groupBy("k").cogroup(texts.groupBy("k")).applyInArrow(_compare(threshold, n), "at long, al int, bt long, bl int, jaccard double")
