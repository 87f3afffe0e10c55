"""Katz backoff of any order as stored tables: one of n-grams and one of contexts for each order, partitioned by hash.

The model is that of :mod:`loomwork.llm.katz`, for histories of up to ``order`` - 1 tokens: a text begins with one BEGIN, which is
a context only, and shorter histories stand at its start. An n-gram's row has its probability, a context's its backoff
weight; a token's probability is looked up from the highest order down, and what no table holds is the unknown class.
Every step is a join or an aggregation by a 64-bit hash, so any order fits any memory, at the price of exchanges: see the README.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import new_path, staged
from loomwork.llm.katz import FOLDS, K, discounts

BEGIN, END = -1, -2
#: Parts of each stored table.
SLOTS = 16
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Tables:
    """Folders of the tables: grams (g, p) and contexts (h, a) by order and slot; p and a are log10. ``unknown`` is log10 of the unknown class."""

    order: int
    path: str
    tokens: int
    unknown: float

    def grams(self, spark: SparkSession, k: int) -> DataFrame:
        return spark.read.schema("g long, p double").parquet(f"{self.path}/grams/order={k}").select("g", "p")

    def contexts(self, spark: SparkSession, k: int) -> DataFrame:
        return spark.read.schema("h long, a double").parquet(f"{self.path}/contexts/order={k}").select("h", "a")


def tokens(text: Column) -> Column:
    """Hashes of a text's words, A-Z in lower case, then END; a null text is END alone."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), *LOWER), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.concat(F.transform(words, lambda w: F.xxhash64(w)), F.array(F.lit(END).cast("long")))


def windows(rows: DataFrame, order: int) -> DataFrame:
    """A row for each token of ``t`` (array<long>): the other columns, g1, h1, g2, h2, ...: hashes of the n-grams that end in it and of their contexts, null where the text's start is in the way."""
    keep = [c for c in rows.columns if c != "t"]
    held = F.concat(F.array(F.lit(BEGIN).cast("long")), F.col("t"))
    at = F.sequence(F.lit(1), F.size("t"))
    out = rows.withColumn("_t", held).select(*keep, F.explode(F.transform(at, lambda i: F.slice(F.col("_t"), F.greatest(i - order + 2, F.lit(1)), F.least(i + 1, F.lit(order))))).alias("_w"))
    columns = []
    for k in range(1, order + 1):
        fits = F.size("_w") >= k
        columns += [F.when(fits, F.xxhash64(F.lit(k), F.slice("_w", -k, k) if k > 1 else F.element_at("_w", -1))).alias(f"g{k}"), F.when(fits, F.xxhash64(F.lit(k), F.slice("_w", -k, k - 1)) if k > 1 else F.lit(0).cast("long")).alias(f"h{k}")]
    return out.select(*keep, *columns)


def fit_tables(spark: SparkSession, docs: DataFrame, order: int = 3, folds: int = FOLDS) -> Tables:
    """Tables of the training texts: rows whose crc32(doc_id as text) mod ``folds`` is not 0, a null doc_id among them."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    rows = windows(docs.filter(~held_out).select(tokens(F.col("text").cast("string")).alias("t")), order)
    path = new_path(spark, "katz-tables")
    store = lambda df, key, name, k: df.withColumn("slot", F.pmod(F.col(key), F.lit(SLOTS))).write.option("compression", "zstd").partitionBy("slot").parquet(f"{path}/{name}/order={k}")
    lower, total, unknown = None, 0, 0.0
    for k in range(1, order + 1):
        below = [f"g{k - 1} AS s"] if k > 1 else []
        counts = rows.filter(F.col(f"g{k}").isNotNull()).groupBy(F.col(f"g{k}").alias("g"), F.col(f"h{k}").alias("h"), *(F.expr(b.split(" AS ")[0]).alias("s") for b in below)).agg(F.count("*").alias("c"))
        counts = staged(spark, counts, f"counts-{k}")
        of = np.zeros(K + 3, np.int64)
        for r in counts.groupBy(F.least("c", F.lit(K + 2)).alias("c")).count().collect():
            of[r.c] = r["count"]
        d = discounts(of.tolist())
        small = F.array(*(F.lit(float(x)) for x in d.small))
        kept = F.when(F.col("c") < len(d.small), F.get(small, F.col("c").cast("int")) * F.col("c")).otherwise(F.col("c") - F.lit(float(d.tail)))
        if k == 1:
            sums = counts.agg(F.sum("c").alias("n"), F.sum(kept).alias("kept")).first()
            total = sums.n or 0
            unknown = 1 - (sums.kept or 0.0) / total if total else 1.0
            lower = staged(spark, counts.select("g", (kept / max(total, 1)).alias("p")), "probabilities-1")
        else:
            contexts = staged(spark, counts.groupBy("h").agg(F.sum("c").alias("n")), f"contexts-{k}")
            seen = counts.withColumn("kept", kept).join(contexts, "h").join(lower.select(F.col("g").alias("s"), F.col("p").alias("below")), "s")
            seen = staged(spark, seen.select("g", "h", "below", (F.col("c") - F.col("kept")).alias("freed"), "n", (F.col("kept") / F.col("n")).alias("p")), f"seen-{k}")
            weights = seen.groupBy("h").agg((F.sum("freed") / F.first("n") / (1 - F.sum("below"))).alias("a"))
            store(weights.select("h", F.log10("a").alias("a")), "h", "contexts", k)
            lower = seen.select("g", "p")
        store(lower.select("g", F.log10("p").alias("p")), "g", "grams", k)
    return Tables(order, path, total, float(np.log10(unknown)) if unknown > 0 else float("-inf"))


def score_with(spark: SparkSession, tables: Tables, docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, score) of each row; score is the log10 probability of the whole text.

    Different n-grams are looked up once: those of the highest order first, and what isn't there adds its context's backoff
    weight and goes on to the next order. Repeated rows each come back; a null text is its end alone; a null doc_id stays.
    """
    rows = staged(spark, docs.select("doc_id", tokens(F.col("text").cast("string")).alias("t"), F.monotonically_increasing_id().alias("_row")), "eval")
    order = tables.order
    found = windows(rows.select("_row", "t"), order)
    top = F.coalesce(*(F.col(f"g{k}") for k in range(order, 0, -1)))  # the longest n-gram there is
    counted = staged(spark, found.groupBy("_row", top.alias("top")).agg(F.count("*").alias("n")), "eval-grams")
    names = [f"{x}{k}" for k in range(1, order + 1) for x in "gh"]
    todo = staged(spark, found.groupBy(top.alias("top")).agg(*(F.first(c).alias(c) for c in names)).withColumn("acc", F.lit(0.0)), "asked")
    done = None
    for k in range(order, 0, -1):
        met = todo.join(tables.grams(spark, k).withColumnRenamed("g", f"g{k}"), f"g{k}", "left")
        hit = met.filter(F.col("p").isNotNull()).select("top", (F.col("acc") + F.col("p")).alias("logp"))
        rest = met.filter(F.col("p").isNull()).drop("p", f"g{k}")
        if k > 1:
            rest = rest.join(tables.contexts(spark, k).withColumnRenamed("h", f"h{k}"), f"h{k}", "left").withColumn("acc", F.col("acc") + F.coalesce("a", F.lit(0.0))).drop("a", f"h{k}")
            todo = staged(spark, rest, f"left-{k}")
        else:
            hit = hit.unionByName(rest.select("top", (F.col("acc") + F.lit(tables.unknown)).alias("logp")))
        done = hit if done is None else done.unionByName(hit)
    sums = counted.join(staged(spark, done, "resolved"), "top").groupBy("_row").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.col("logp")).alias("score"))
    return rows.select("doc_id", "_row").join(sums, "_row").select("doc_id", "n_tokens", "score")
