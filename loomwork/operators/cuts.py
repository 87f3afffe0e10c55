"""Exact cuts through ordered groups of any size: of each group the rows whose running weight falls short of a target.

No task holds or sorts a group. Weights are summed by prefixes of the order key; the prefix in which a group's sum reaches
its target is refined until few keys are left, and the key at which to cut comes out. Rows are then compared with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomwork.operators.store import held

#: Different keys of one group among which the cut is looked up at once; more of them are refined first.
CELL = 50_000
#: Characters by which a prefix grows: up to 4096 sums a group, if the key is hexadecimal.
DIGITS = 3


def order_text(key: Column, kind: T.DataType) -> Column:
    """``key`` as text in the same order: strings as they are, whole numbers as 16 digits; null comes first."""
    if isinstance(kind, T.StringType):
        text = key
    elif isinstance(kind, T.IntegralType):
        text = F.lpad(F.hex(key.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    else:
        raise TypeError(f"rows are ordered by a string or a whole number, not by {kind.simpleString()}")
    return F.when(key.isNotNull(), F.concat(F.lit("1"), text)).otherwise("0")


def _common(a: Column, b: Column) -> Column:
    """The longest common beginning of two strings."""
    return F.left(a, F.array_max(F.filter(F.sequence(F.lit(0), F.length(a)), lambda i: F.left(a, i) == F.left(b, i))))


def _group(cuts: DataFrame, rows: DataFrame, by: list[str]) -> Column:
    """The join condition of equal groups, nulls alike."""
    out = F.lit(True)
    for i, b in enumerate(by):
        out = out & rows[b].eqNullSafe(cuts[f"_by{i}"])
    return out


def mark(df: DataFrame, by: list[str], key: Column | str, goal: Callable[[DataFrame], DataFrame], weight: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """``df`` with _in: whether the weight of the rows before a row, in order of ``key`` within its group, is below the group's target.

    ``goal`` gets one row a group (the columns of ``by``, _n rows, _total weight) and adds _target (long). ``weight`` is a
    column of whole numbers, none negative (null: 0); without it each row weighs 1, so a target is a number of rows. Rows of
    equal key go by a hash of the columns ``ties`` (None: all; none are needed if keys are unique), then in any order.
    Null groups are a group. One pass over the rows for the totals, one for every factor of 4096 by which a group exceeds
    CELL, one for the cut and one for the marks.
    """
    key = F.col(key) if isinstance(key, str) else key
    kind = df.select(key.alias("k")).schema["k"].dataType
    last = [c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)] if ties is None else ties
    place = F.concat(order_text(key, kind), F.lit("\0"), F.lpad(F.hex(F.xxhash64(*(f"`{c}`" for c in last))), 16, "0")) if last else order_text(key, kind)
    w = F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(1).cast("long")
    names = [f"_by{i}" for i in range(len(by))]
    rows = df.select(*by, place.alias("_place"), w.alias("_w"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.sum("_w").alias("_total"), F.min("_place").alias("_lo"), F.max("_place").alias("_hi"))
    edges = goal(sizes).filter("_n > 0").select(*(F.col(b).alias(n) for b, n in zip(by, names, strict=True)), F.col("_target").cast("long").alias("_target"), (F.col("_total") <= F.col("_target")).alias("_all"), "_n", _common(F.col("_lo"), F.col("_hi")).alias("_prefix"), F.lit(0).cast("long").alias("_before"), (F.col("_lo") == F.col("_hi")).alias("_one"))
    edges, small = held(edges)
    done = edges.filter("_all OR _target <= 0").select(*names, "_all", F.lit(None).cast("string").alias("_cut"), F.lit(0).cast("long").alias("_take"), F.lit(0).cast("long").alias("_of"))
    edges = edges.filter("NOT _all AND _target > 0")
    while edges.filter((F.col("_n") > CELL) & ~F.col("_one")).limit(1).count():
        edges, small = held(_refined(rows, edges, by, names, small).unionByName(edges.filter((F.col("_n") <= CELL) | F.col("_one"))))
    cuts, small = held(_cut(rows, edges, by, names, small).unionByName(done))
    marked = df.withColumn("_place", place)
    marked = marked.join(F.broadcast(cuts) if small else cuts, _group(cuts, marked, by))
    at = F.col("_place") == F.col("_cut")
    inside = F.col("_all") | F.coalesce(F.col("_place") < F.col("_cut"), F.lit(False))
    if cuts.filter("_take < _of").limit(1).count():  # the cut goes through rows of one key: only those are numbered
        part = marked.filter(at & (F.col("_take") < F.col("_of"))).withColumn("_in", F.row_number().over(W.partitionBy(*names, "_place").orderBy(w)) <= F.col("_take"))
        rest = marked.filter(F.coalesce(~at | (F.col("_take") >= F.col("_of")), F.lit(True))).withColumn("_in", inside | F.coalesce(at, F.lit(False)))
        return rest.select(*df.columns, "_in").unionByName(part.select(*df.columns, "_in"))
    return marked.withColumn("_in", inside | F.coalesce(at, F.lit(False))).select(*df.columns, "_in")


def _refined(rows: DataFrame, edges: DataFrame, by: list[str], names: list[str], small: bool) -> DataFrame:
    """Edges of groups that are too large, with a longer prefix: that in which the running weight reaches the target."""
    wide = edges.filter((F.col("_n") > CELL) & ~F.col("_one")).drop("_all", "_n", "_one")
    inside = rows.join(F.broadcast(wide) if small else wide, _group(wide, rows, by) & F.startswith(F.col("_place"), F.col("_prefix")))
    bins = inside.groupBy(*names, "_target", "_before", F.left(F.col("_place"), F.length("_prefix") + DIGITS).alias("_bin")).agg(F.sum("_w").alias("w"), F.count("*").alias("n"), F.min("_place").alias("lo"), F.max("_place").alias("hi"))
    bins = bins.groupBy(*names, "_target", "_before").agg(F.array_sort(F.collect_list(F.struct("_bin", "w", "n", "lo", "hi"))).alias("_bins"))
    start = F.struct(F.col("_before").alias("before"), F.lit(None).cast("struct<_bin:string,w:bigint,n:bigint,lo:string,hi:string>").alias("hit"))

    def step(s: Column, x: Column) -> Column:
        reached = s["before"] + x["w"] >= F.col("_target")
        return F.when(s["hit"].isNotNull(), s).when(reached, F.struct(s["before"].alias("before"), x.alias("hit"))).otherwise(F.struct((s["before"] + x["w"]).alias("before"), s["hit"].alias("hit")))

    found = bins.withColumn("_s", F.aggregate("_bins", start, step))
    hit = F.col("_s.hit")
    return found.select(*names, "_target", F.lit(False).alias("_all"), hit["n"].alias("_n"), _common(hit["lo"], hit["hi"]).alias("_prefix"), F.col("_s.before").alias("_before"), (hit["lo"] == hit["hi"]).alias("_one"))


def _cut(rows: DataFrame, edges: DataFrame, by: list[str], names: list[str], small: bool) -> DataFrame:
    """(group, _all, _cut, _take, _of): the last key that is in, how many rows of it are, and how many there are."""
    edges = edges.drop("_all", "_n", "_one")
    inside = rows.join(F.broadcast(edges) if small else edges, _group(edges, rows, by) & F.startswith(F.col("_place"), F.col("_prefix")))
    # rows of one key and weight are one entry
    keys = inside.groupBy(*names, "_target", "_before", "_place", "_w").agg(F.count("*").alias("c"))
    keys = keys.groupBy(*names, "_target", "_before").agg(F.array_sort(F.collect_list(F.struct(F.col("_place").alias("p"), F.col("_w").alias("w"), "c"))).alias("_keys"))
    none = F.lit(0).cast("long")
    start = F.struct(F.col("_before").alias("before"), F.lit(None).cast("string").alias("cut"), none.alias("take"), none.alias("of"))

    def step(s: Column, x: Column) -> Column:
        short = F.col("_target") - s["before"]
        taken = F.when(short <= 0, 0).when(x["w"] == 0, x["c"]).otherwise(F.least(x["c"], F.ceil(F.try_divide(short, x["w"])))).cast("long")
        again = s["cut"].eqNullSafe(x["p"])  # a key with rows of several weights
        of = F.when(again, s["of"]).otherwise(none) + x["c"]
        more = F.struct((s["before"] + x["w"] * x["c"]).alias("before"), x["p"].alias("cut"), (F.when(again, s["take"]).otherwise(none) + taken).alias("take"), of.alias("of"))
        return F.when((taken > 0) | again, more).otherwise(s)

    return keys.withColumn("_s", F.aggregate("_keys", start, step)).select(*names, F.lit(False).alias("_all"), F.col("_s.cut").alias("_cut"), F.col("_s.take").alias("_take"), F.col("_s.of").alias("_of"))


def fixed_goal(target: Column | int) -> Callable[[DataFrame], DataFrame]:
    """The same target, or one by an expression over the group's columns, _n and _total."""
    return lambda sizes: sizes.withColumn("_target", F.lit(target) if isinstance(target, int) else target)
