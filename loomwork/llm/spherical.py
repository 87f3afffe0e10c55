"""Embedding near-dedup: spherical k-means cells, blocked cosine products within them, one representative of each group.

A vector lives in the cell of its nearest centroid and visits those cells whose border it is near. Of two vectors within the
angle of a link that live in different cells, one at least is within half that angle of the border between them, so with
that margin no link is missed. In many dimensions a step of that length hardly ever points straight at a border; the margin
used is SPREAD standard deviations of what a step in a random direction has across it, if that is less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import components, doc_key, from_doc_key, skew_safe_lookup, staged

THRESHOLD = 0.95
#: Numbers in a block of vectors that one task compares with another block; an eighth of it is a cell's aim.
BLOCK_VALUES = 1 << 21
#: Centroids are broadcast: this many at most, and this many numbers at most (64 MB).
MAX_CELLS = 1 << 14
MAX_VALUES = 1 << 24
#: The fit: vectors of the sample for each cell (those of least hash, about that many), and rounds over them.
SAMPLE_PER_CELL = 64
ROUNDS = 4
SPREAD = 3.0
#: Sums of unit vectors are whole numbers of this fineness, so their order doesn't count.
FINE = 1 << 20
#: Numbers that one product makes at once.
TILE = 1 << 22
HOME, GUEST, CORE = 0, 1, 2


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths in double precision; rows may be as large or small as doubles are, but not zero."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column, width: int) -> np.ndarray:
    """The rows of an Arrow list column."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def linkable(vector: Column) -> Column:
    """Whether a vector (array<double>) is neither null nor zero and holds finite components only."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def fit_centroids(spark: SparkSession, vectors: DataFrame, n: int, width: int, cells: int) -> np.ndarray:
    """Unit centroids (cells at most, width) from about SAMPLE_PER_CELL vectors a cell, those of least hash.

    They start as some of the sample; one within the angle of a link to an earlier one goes, so a crowd of copies holds one
    centroid and not its share of them. The sample is bounded by the bound on the cells; sums come to the driver, a row a cell.
    """
    rate = min(1.0, SAMPLE_PER_CELL * cells / n)
    draw = F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 32))
    sample = staged(spark, vectors.filter(draw <= int(rate * (1 << 32))).select("h", "v"), "sample")
    first = sample.orderBy(F.xxhash64("h", F.lit(2)), "h").limit(cells).select("v").toArrow()
    centroids = spaced(unit_rows(_matrix(first.column(0).combine_chunks(), width))) if first.num_rows else np.zeros((0, width))
    for _ in range(ROUNDS if len(centroids) > 1 else 0):
        known = spark.sparkContext.broadcast(centroids.astype(np.float32))

        def sums(batches: Iterator, known=known) -> Iterator:
            import pyarrow as pa

            total = np.zeros((len(known.value), width), np.int64)
            for b in batches:
                u = unit_rows(_matrix(b.column(0), width))
                for a in range(0, len(u), max(1, TILE // len(total))):
                    part = u[a : a + max(1, TILE // len(total))]
                    np.add.at(total, (part.astype(np.float32) @ known.value.T).argmax(axis=1), np.rint(part * FINE).astype(np.int64))
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(map(bytes, total[used])), pa.binary())], names=["cell", "sum"])

        def add(table):
            import pyarrow as pa

            total = sum(np.frombuffer(x, np.int64) for x in table.column("sum").to_pylist())
            return pa.table({"cell": table.column("cell")[:1], "sum": pa.array([total.tobytes()], pa.binary())})

        for r in sample.select("v").mapInArrow(sums, "cell long, sum binary").groupBy("cell").applyInArrow(add, "cell long, sum binary").collect():
            total = np.frombuffer(r["sum"], np.int64)
            if total.any():
                centroids[r.cell] = unit_rows(total[None])[0]
        known.destroy()
        centroids = spaced(centroids)
    return centroids


def spaced(centroids: np.ndarray, least: float = THRESHOLD) -> np.ndarray:
    """Centroids without those that have a cosine of ``least`` or more to an earlier one that stays."""
    kept = np.zeros(len(centroids), bool)
    for a in range(0, len(centroids), 1024):
        block = centroids[a : a + 1024]
        free = ~(block @ centroids[:a][kept[:a]].T >= least).any(axis=1)
        near = block @ block.T >= least
        for i in np.flatnonzero(free):
            kept[a + i] = not near[i, :i][kept[a : a + i]].any()
    return centroids[kept]


def place(spark: SparkSession, vectors: DataFrame, centroids: np.ndarray, width: int, margin: float, core: float) -> DataFrame:
    """``vectors`` (h, m, v) with home (int), guest (array<int>: cells it visits) and core: within ``core`` (a cosine) of the home's centroid."""
    known = spark.sparkContext.broadcast(centroids)
    kind = vectors.schema["v"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = known.value
        c32 = c.astype(np.float32)
        step = max(1, TILE // len(c))
        for b in batches:
            u = unit_rows(_matrix(b.column("v"), width))
            home, inner = np.zeros(len(u), np.int32), np.zeros(len(u), bool)
            at, guests = [np.zeros(1, np.int32)], []
            for a in range(0, len(u), step):
                s = u[a : a + step].astype(np.float32) @ c32.T
                mine = s.argmax(axis=1)
                gap = s[np.arange(len(s)), mine][:, None] - s
                gap[np.arange(len(s)), mine] = np.inf
                # centroids are two apart at most; only those near enough for that are looked at
                row, cell = np.nonzero(gap <= 2 * margin + 1e-6)
                apart = np.concatenate([np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", c[mine[row[i : i + 65536]]], c[cell[i : i + 65536]]), 0)) for i in range(0, len(row), 65536)] or [np.zeros(0)])
                near = gap[row, cell] <= margin * apart + 1e-6
                home[a : a + step], inner[a : a + step] = mine, np.einsum("ij,ij->i", u[a : a + step], c[mine]) >= core
                guests.append(cell[near].astype(np.int32))
                at.append(np.bincount(row[near], minlength=len(s)).astype(np.int32))
            guest = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(at), dtype=np.int32)), pa.array(np.concatenate(guests) if guests else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home), guest, pa.array(inner)], names=["h", "m", "v", "home", "guest", "core"])

    return vectors.select("h", "m", "v").mapInArrow(run, f"h long, m long, v {kind}, home int, guest array<int>, core boolean")


def dealt(placed: DataFrame, cells: DataFrame, block: int) -> DataFrame:
    """A row of ``placed`` for each comparison that it takes part in: (leaf, kind, i, j, first) say which, role says as what.

    Members and guests of a cell are cut into blocks by hash, and so is its core. Kind 0 compares block i with block j, j not
    less than i; kind 1 compares block i with block j of the core. Nothing compares the core with itself: all of it links.
    """
    role = lambda r: F.struct(F.col("home").alias("leaf"), F.lit(r).alias("role"))
    own = F.when(F.col("core"), role(CORE)).otherwise(role(HOME))
    guests = F.transform("guest", lambda c: F.struct(c.alias("leaf"), F.lit(GUEST).alias("role")))
    rows = placed.withColumn("_x", F.explode(F.concat(F.array(own), guests))).select("h", "m", "v", "home", "guest", "_x.leaf", "_x.role")
    rows = rows.join(F.broadcast(cells.select("leaf", F.ceil(F.col("n_open") / block).cast("int").alias("a"), F.ceil(F.col("n_core") / block).cast("int").alias("c"))), "leaf")
    rows = rows.withColumn("b", F.pmod(F.xxhash64("h", F.lit(3)), F.greatest(F.lit(1), F.when(F.col("role") == CORE, F.col("c")).otherwise(F.col("a")))).cast("int"))
    part = lambda kind, i, j, first: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), first.alias("first"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    among = F.transform(upto("a"), lambda j: part(0, F.least(F.col("b"), j), F.greatest(F.col("b"), j), j >= F.col("b")))
    to_core = F.transform(upto("c"), lambda j: part(1, F.col("b"), j, F.lit(True)))
    from_core = F.transform(upto("a"), lambda i: part(1, i, F.col("b"), F.lit(False)))
    parts = F.when(F.col("role") == CORE, from_core).otherwise(F.concat(among, to_core))
    return rows.withColumn("_p", F.explode(parts)).select("leaf", "_p.kind", "_p.i", "_p.j", "_p.first", "role", "h", "m", "home", "guest", "v")


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each row's least known companion, fully followed) after the links a-b."""
    while True:
        x, y = label[a], label[b]
        off = x != y
        if not off.any():
            return label
        a, b, x, y = a[off], b[off], x[off], y[off]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (follow := label[label] != label).any():
            label[follow] = label[label[follow]]


def compare(threshold: float, width: int, cells: int):
    """The function that finds the links of one comparison: (h, label, n), n the vectors that a row links with there, label another row it is joined to."""

    def run(key, table):
        import pyarrow as pa

        leaf, kind, i, j = (k.as_py() for k in key)
        first = table.column("first").to_numpy()
        role = table.column("role").to_numpy()
        # first block before the second, members before guests
        order = np.lexsort((role, ~first))
        split = int(first.sum())
        role = role[order]
        column = lambda name: table.column(name).to_numpy()[order]
        h, m, home = column("h"), column("m"), column("home").astype(np.int64)
        u = unit_rows(_matrix(table.column("v").combine_chunks(), width)[order])
        u32 = u.astype(np.float32)
        guest = table.column("guest").combine_chunks().take(pa.array(order))
        sizes = guest.value_lengths().to_numpy(zero_copy_only=False)
        visits = np.repeat(np.arange(len(order)), sizes) * cells + guest.flatten().to_numpy(zero_copy_only=False)
        n, label = np.zeros(len(order), np.int64), np.arange(len(order))
        same = kind == 0 and i == j
        members = [int((role[:split] == HOME).sum()), split + int((role[split:] == HOME).sum())]
        slack = (width + 8) * 1.2e-7
        # rows of the first block with columns of the second: guests meet members and core only
        areas = [(0, members[0], 0, split)] if same else [(0, members[0], split, len(order)), (members[0], split, split, len(order) if kind else members[1])]
        for r0, r1, c0, c1 in areas:
            for c in range(c0, c1, 8192):
                wide = min(c + 8192, c1)
                for r in range(r0, r1, max(1, TILE // 8192)):
                    tall = min(r + max(1, TILE // 8192), r1)
                    if same and wide <= r + 1:
                        continue
                    a, b = np.nonzero(u32[r:tall] @ u32[c:wide].T >= threshold - slack)
                    a, b = a + r, b + c
                    if same:  # each pair once
                        a, b = a[a < b], b[a < b]
                    for x in range(0, len(a), 1 << 16):
                        p, q = a[x : x + (1 << 16)], b[x : x + (1 << 16)]
                        ok = np.einsum("ij,ij->i", u[p], u[q]) >= threshold
                        p, q = p[ok], q[ok]
                        # a member and a guest may meet in the guest's cell too; there, if that is the lesser
                        mine, other = np.where(role[p] == GUEST, q, p), np.where(role[p] == GUEST, p, q)
                        twice = (role[other] == GUEST) & (home[other] < leaf) & np.isin(mine * cells + home[other], visits)
                        p, q = p[~twice], q[~twice]
                        n += np.bincount(p, m[q], len(n)).astype(np.int64) + np.bincount(q, m[p], len(n)).astype(np.int64)
                        label = _joined(label, p, q)
        found = np.flatnonzero(n)
        return pa.table({"h": h[found], "label": h[label[found]], "n": n[found]})

    return run


def near_vectors(spark: SparkSession, rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, spread: float | None = SPREAD, cell_rows: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    Rows link whose vectors have a cosine of ``threshold`` or more in double precision. n_links (long): rows linked directly;
    component_id: the least id reachable by links, the own one included; kept: the id is that least one. ``spread`` sets
    the margin within which a vector visits a cell beside its own, see the module; None: a margin that misses no link.
    ``cell_rows``: the aim for a cell's members. The threshold is positive.

    A null vector, a zero one, one with a null, NaN or infinite component, and one of another length than most have link with
    nothing: they come back with no links, as their own component. Equal vectors are one vector with a count of its rows
    (found by a 64-bit hash). Rows without an id count as those of largest id, and their component is null if none has one.
    Repeated rows all come back and link with each other; each is kept if its id is its component's. An empty table gives an
    empty result. Other columns don't come back, whatever their names.

    A crowd of different vectors within half the angle of a link around a centroid is known to link with itself, and is
    compared with the cell's other vectors only. What is left of a large cell is cut into blocks, each pair of blocks a task.
    """
    spread = math.inf if spread is None else spread
    v = F.col(f"`{vector}`")
    keyed = rows.select(F.col(f"`{id_col}`").alias("id"), doc_key(f"`{id_col}`").alias("k"), v.alias("v"), linkable(v.cast("array<double>")).alias("ok"))
    lengths = keyed.filter("ok").groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    width = lengths.n if lengths else 0
    keyed = keyed.withColumn("ok", F.col("ok") & (F.size("v") == width)).withColumn("h", F.when(F.col("ok"), F.xxhash64("v")).otherwise(F.xxhash64("k", F.lit(4))))
    vectors = staged(spark, keyed.filter("ok").groupBy("h").agg(F.count("*").alias("m"), F.min("k").alias("k"), F.first("v").alias("v")), "vectors")
    n = vectors.count()
    nothing = keyed.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return nothing.toDF(id_col, "n_links", "component_id", "kept")
    block = max(1024, BLOCK_VALUES // width)
    cells = int(min(MAX_CELLS, MAX_VALUES // width, n // (cell_rows or block // 8))) or 1
    centroids = fit_centroids(spark, vectors, n, width, cells)
    angle = math.acos(threshold)
    # the core's angle is a hair less than half a link's, so that rounding links none that shouldn't
    margin = min(math.sin(angle / 2), spread * math.sin(angle) / (2 * math.sqrt(width)))
    placed = staged(spark, place(spark, vectors, centroids, width, margin, math.cos(angle / 2) + 1e-9), "placed")
    own = placed.groupBy(F.col("home").alias("leaf")).agg(F.count_if(~F.col("core")).alias("n_open"), F.count_if("core").alias("n_core"), F.sum(F.when(F.col("core"), F.col("m"))).alias("core_m"), F.min(F.when(F.col("core"), F.col("h"))).alias("core_h"))
    guests = placed.select(F.explode("guest").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n_guests"))
    held = own.join(guests, "leaf", "left").withColumn("n_open", F.col("n_open") + F.coalesce("n_guests", F.lit(0))).drop("n_guests")
    held = staged(spark, held, "cells")
    found = dealt(placed, held, block).groupBy("leaf", "kind", "i", "j").applyInArrow(compare(threshold, width, len(centroids)), "h long, label long, n long")
    found = staged(spark, found, "found")
    crowd = placed.filter("core").join(F.broadcast(held.select(F.col("leaf").alias("home"), "core_m", "core_h")), "home")
    links = found.select("h", "n").unionByName(crowd.select("h", (F.col("core_m") - F.col("m")).alias("n"))).groupBy("h").agg(F.sum("n").alias("n"))
    edges = found.filter("label <> h").select(F.col("h").alias("a"), F.col("label").alias("b")).unionByName(crowd.filter("core_h <> h").select(F.col("h").alias("a"), F.col("core_h").alias("b")))
    labels = components(spark, edges).select(F.col("node").alias("h"), "label")
    nodes = vectors.select("h", "m", "k").join(links, "h", "left").join(labels, "h", "left").select("h", "m", "k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("label", "h").alias("label"))
    nodes = staged(spark, nodes, "nodes")
    least = staged(spark, nodes.groupBy("label").agg(F.min("k").alias("least"), F.count("*").alias("_n")), "least")
    nodes = skew_safe_lookup(nodes, least, ["label"], ["least"], "_n", ["h"]).select("h", F.lit(True).alias("ok"), "m", (F.col("n") + F.col("m") - 1).alias("n"), "least")
    nodes = staged(spark, nodes, "linked")
    out = skew_safe_lookup(keyed.select("id", "k", "h", "ok"), nodes, ["h", "ok"], ["n", "least"], "m", ["k"])
    least = F.coalesce("least", "k")
    kind = keyed.schema["id"].dataType
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), from_doc_key(least).cast(kind).alias("component_id"), (F.col("k") == least).alias("kept"))
