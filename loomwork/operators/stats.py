"""Grouped reports: order statistics, profiles, quadrants, calibration, paired tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def order_statistic(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None, method: str = "floor_np") -> DataFrame:
    """One row a group with an exact order statistic of ``value`` for each name in ``shares``; nulls don't count.

    floor_np: sorted[min(n - 1, int(n p))]; floor_n1: sorted[int(p (n - 1))]; interpolated: the usual percentile. By counts of
    distinct values and running sums, so a group's rows meet in one task only as distinct values.
    """
    by = by or []
    if method == "interpolated":
        return df.groupBy(*by).agg(*(F.percentile(value, p).alias(name) for name, p in shares.items()))
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    # without groups there is one frame; it holds distinct values only
    frame = W.partitionBy(*by).orderBy(value)
    upto = F.sum("_n").over(frame.rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum("_n").over(W.partitionBy(*by))
    ranked = counted.withColumns({"_upto": upto, "_total": total})
    n = F.col("_total")
    at = {name: F.least(n - 1, F.floor(n * p)) if method == "floor_np" else F.floor((n - 1) * p) for name, p in shares.items()}
    hit = {name: (F.col("_upto") > i) & (F.col("_upto") - F.col("_n") <= i) for name, i in at.items()}
    return ranked.groupBy(*by).agg(*(F.max(F.when(h, F.col(value))).alias(name) for name, h in hit.items()))


def share(condition: Column) -> Column:
    """Share of rows for which it holds."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def grouping_report(df: DataFrame, a: str, b: str, kind: str, kinds: list[str]) -> DataFrame:
    """Counts of each kind overall, by ``a``, by ``b`` and by both; what a row is not grouped by is ``all``."""
    sets = df.groupingSets([[], [a], [b], [a, b]], a, b)
    out = sets.agg(F.count("*").alias("n"), *(F.count_if(F.col(kind) == k).alias(k) for k in kinds), F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"))
    name = lambda c, g: F.when(F.col(g) == 1, "all").otherwise(F.col(c)).alias(c)
    return out.select(name(a, "_ga"), name(b, "_gb"), "n", *kinds)


def length_profile(df: DataFrame, value: str) -> DataFrame:
    """min, max, mean, order statistics and shares of very short and long values, in one row."""
    n = order_statistic(df, value, {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9})
    base = df.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), share(F.col(value) < 10).alias("short_share"), share(F.col(value) > 2000).alias("long_share"))
    return base.crossJoin(F.broadcast(n))


def model_report(df: DataFrame, model: str = "model") -> DataFrame:
    """Rates and think lengths of each model. Columns: the model, kind, complete, think_len."""
    rates = df.groupBy(model).agg(
        F.count("*").alias("total"), share(F.col("kind") == "correct").alias("accuracy"), share(F.col("complete")).alias("completeness"),
        *(share(F.col("kind") == k).alias(f"{k}_rate") for k in ("truncated", "wrong", "no_answer")),
        F.coalesce(F.avg(F.when(F.col("think_len") > 0, F.col("think_len"))), F.lit(0.0)).alias("avg_think_len"),
    )
    median = order_statistic(df.filter("think_len > 0"), "think_len", {"median_think_len": 0.5}, [model])
    return rates.join(median, model, "left").withColumn("median_think_len", F.coalesce("median_think_len", F.lit(0)))


def deltas(report: DataFrame, baseline: str, metrics: list[str], model: str = "model") -> DataFrame:
    """Each model's metrics less those of the baseline, of which there is one row."""
    base = report.filter(F.col(model) == baseline).select(*(F.col(m).alias(f"_{m}") for m in metrics))
    return report.filter(F.col(model) != baseline).crossJoin(F.broadcast(base)).select(model, *((F.col(m) - F.col(f"_{m}")).alias(f"{m}_delta") for m in metrics))


def paired_flips(a: DataFrame, b: DataFrame, key: str, right: str) -> DataFrame:
    """(fixed, broken, both_right, both_wrong, p_value) of rows in both frames; p by the exact test of McNemar."""
    pair = a.select(key, F.col(right).alias("_a")).join(b.select(key, F.col(right).alias("_b")), key)
    out = pair.agg(*(F.count_if(c).alias(n) for n, c in (("fixed", ~F.col("_a") & F.col("_b")), ("broken", F.col("_a") & ~F.col("_b")), ("both_right", F.col("_a") & F.col("_b")), ("both_wrong", ~F.col("_a") & ~F.col("_b")))))
    return out.withColumn("p_value", mcnemar(F.col("fixed"), F.col("broken")))


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of b against c; a fold over log binomials."""
    n = (b + c).cast("int")
    low = F.least(b, c).cast("int")
    start = F.struct(F.lit(0.0).alias("log"), (-n * F.lit(math.log(2.0))).alias("top"), F.exp(-n * F.lit(math.log(2.0))).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        log = s["log"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(log.alias("log"), s["top"].alias("top"), (s["sum"] + F.exp(log + s["top"])).alias("sum"))

    total = F.aggregate(F.when(low >= 1, F.sequence(F.lit(1), low)).otherwise(F.array().cast("array<int>")), start, step)["sum"]
    return F.least(F.lit(1.0), 2 * total)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Means, population deviations, mean difference and correlation of two scorers."""
    return df.agg(F.count("*").alias("n"), F.avg(a).alias(f"{a}_mean"), F.stddev_pop(a).alias(f"{a}_std"), F.avg(b).alias(f"{b}_mean"), F.stddev_pop(b).alias(f"{b}_std"), F.avg(F.col(a) - F.col(b)).alias("mean_delta"), F.corr(a, b).alias("correlation"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlations of all pairs, means and population deviations, in one row."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    return df.agg(*(F.corr(x, y).alias(f"corr_{x}_{y}") for x, y in pairs), *(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def quadrants(df: DataFrame, score: str, right: str) -> DataFrame:
    """tp, fp, tn, fn at the median score (itself high), and rates; a rate over nothing is 0."""
    median = df.agg(F.percentile(score, 0.5).alias("threshold"))
    high, ok = F.col(score) >= F.col("threshold"), F.col(right)
    out = df.crossJoin(F.broadcast(median)).agg(F.max("threshold").alias("threshold"), F.count_if(high & ok).alias("tp"), F.count_if(high & ~ok).alias("fp"), F.count_if(~high & ~ok).alias("tn"), F.count_if(~high & ok).alias("fn"))
    rate = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(x) + F.col(y)), F.lit(0.0))
    return out.withColumns({"fpr": rate("fp", "tn"), "fnr": rate("fn", "tp"), "precision": rate("tp", "fp"), "recall": rate("tp", "fn")})


def quadrant_subtypes(df: DataFrame, score: str, right: str) -> DataFrame:
    """Of false positives those with spread scores (deviation over 0.2) and others; of false negatives short ones and those with a low step."""
    median = df.agg(F.percentile(score, 0.5).alias("threshold"))
    rows = df.crossJoin(F.broadcast(median))
    fp, fn = (F.col(score) >= F.col("threshold")) & ~F.col(right), (F.col(score) < F.col("threshold")) & F.col(right)
    return rows.agg(F.count_if(fp & (F.col("score_std") > 0.2)).alias("fp_high_std"), F.count_if(fp & (F.col("score_std") <= 0.2)).alias("fp_low_std"), F.count_if(fn & (F.col("n_steps") <= 3)).alias("fn_short"), F.count_if(fn & (F.col("score_min") < 0.5)).alias("fn_low_step"))


#: Edges of the calibration buckets; a score of 1 falls in none.
CALIBRATION = (0.0, 0.3, 0.5, 0.7, 0.85, 1.0)


def bucket(value: Column, edges: tuple[float, ...], labels: list[str]) -> Column:
    """Label of the half-open bucket that holds the value, null outside all."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lo, hi, label in zip(edges, edges[1:], labels, strict=False):
        out = out.when((value >= lo) & (value < hi), label)
    return out


def calibration(df: DataFrame, score: str, right: str) -> DataFrame:
    """Rows and accuracy by bucket of the score."""
    labels = [f"[{a},{b})" for a, b in zip(CALIBRATION, CALIBRATION[1:], strict=False)]
    return df.withColumn("bucket", bucket(F.col(score), CALIBRATION, labels)).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"), share(F.col(right)).alias("accuracy"))


def report_markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small report as a Markdown table; raises if it has more than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows)])


STEP = T.StructType([T.StructField("step_idx", T.IntegerType()), T.StructField("step_text", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("reason", T.StringType())])
