"""Repair joins, decontamination, contained items, matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwork.functions.text import balanced_boxes, last, ngrams
from loomwork.operators.store import SMALL_ROWS as BROADCAST_ROWS
from loomwork.operators.store import stored


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def record_key(*columns: str) -> list[Column]:
    """Columns of a record key with null as empty."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_key_{c}") for c in columns]


def consuming_join(left: DataFrame, right: DataFrame, keys: list[str], payload: str, seq: str = "seq", prefer: Column | None = None) -> DataFrame:
    """Left rows, each with the payload of one right row of its key that no other left row takes; null once they run out.

    Left rows take turns by ``seq``; of right rows those that ``prefer`` favours come first, then ``seq`` decides.
    """
    names = [f"_key_{c}" for c in keys]
    l = left.select("*", *record_key(*keys)).withColumn("_rn", F.row_number().over(W.partitionBy(*names).orderBy(seq)))  # noqa: E741
    order = [*([prefer.desc()] if prefer is not None else []), F.col(seq)]
    r = right.select("*", *record_key(*keys)).withColumn("_rn", F.row_number().over(W.partitionBy(*names).orderBy(*order)))
    r = r.select(*names, "_rn", F.col(payload).alias(f"matched_{payload}"), F.lit(True).alias("matched"))
    out = l.join(r, [*names, "_rn"], "left")
    return out.select(*left.columns, f"matched_{payload}", F.coalesce("matched", F.lit(False)).alias("matched"))


def repair_answers(records: DataFrame, intermediates: DataFrame, token_length: Column, max_length: int = 2048) -> DataFrame:
    """``records`` with the last box of a consumed intermediate as answer, and repair_status: accepted or why not.

    ``token_length`` is of the repaired row; its columns are those of ``records``.
    """
    keys = ["source", "instruction", "reasoning"]
    has_box = F.size(F.filter(balanced_boxes("answer"), lambda b: b != "")) > 0
    rows = consuming_join(records, intermediates, keys, "answer", prefer=has_box)
    rows = rows.withColumn("_box", last(F.filter(balanced_boxes("matched_answer"), lambda b: b != "")))
    rows = rows.withColumn("answer", F.coalesce("_box", "answer")).withColumn("sft_token_length", token_length)
    status = F.when(~F.col("matched"), "intermediate_join_missing").when(F.col("_box").isNull(), "no_balanced_box").when(F.col("sft_token_length") > max_length, "too_long_after_repair").otherwise("accepted")
    return rows.withColumn("repair_status", status).drop("_box", "matched", "matched_answer")


def gather_last_box(left: DataFrame, right: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """``left`` with reliable_answer: the last non-empty box over all right rows of its key in order; null if there is none."""
    names = [f"_key_{c}" for c in keys]
    boxes = right.select(*record_key(*keys), seq, last(F.filter(balanced_boxes("answer"), lambda b: b != "")).alias("_box")).filter("_box IS NOT NULL")
    best = boxes.groupBy(*names).agg(F.max_by("_box", seq).alias("reliable_answer"))
    return left.select("*", *record_key(*keys)).join(best, names, "left").drop(*names)


def zip_rows(a: DataFrame, b: DataFrame, check: str, seq: str = "seq") -> DataFrame:
    """Rows of equal ``seq``, the right one's columns prefixed b_; fails where ``check`` differs; rows in one frame only go."""
    right = b.select(F.col(seq), *(F.col(c).alias(f"b_{c}") for c in b.columns if c != seq))
    same = F.assert_true(F.col(check).eqNullSafe(F.col(f"b_{check}")), F.lit("rows do not match"))
    return a.join(right, seq).withColumn("_ok", same).filter("_ok IS NULL").drop("_ok")


def last_by_key(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """One row a key, the last; adds join_key."""
    rows = df.withColumn("join_key", key)
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy("join_key").orderBy(F.desc(seq)))).filter("_rn = 1").drop("_rn")


def exact_overlap(df: DataFrame, other: DataFrame, key: str, anti: bool = False) -> DataFrame:
    """Rows whose key occurs in ``other`` (or doesn't); ``other`` is broadcast if it is small, by count."""
    keys = other.select(key).distinct()
    return df.join(F.broadcast(keys) if small_enough(keys) else keys, key, "left_anti" if anti else "left_semi")


def evaluation_signatures(frames: list[DataFrame], text: str, n: int = 5) -> DataFrame:
    """(signature, text, grams): the different normal forms in all evaluation sets, with their SHA-256 and their n-gram sets."""
    out = frames[0].select(text)
    for f in frames[1:]:
        out = out.unionByName(f.select(text))
    out = out.groupBy(F.sha2(text, 256).alias("signature")).agg(F.first(text).alias(text))
    return out.select("signature", text, ngrams(text, n).alias("grams"))


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str) -> DataFrame:
    """(doc_id, item_id) where the item's normal form is a part of the document's; empty and null items are in none.

    An item's grams have a length of 16 characters, or of the greatest power of two that it has. Of a document's grams those
    that are in items are kept; the one of an item's that fewest documents have makes the candidates, and the texts decide.
    Items of a gram that no document has are out. Any number of items; one that occurs in many documents costs as much as its
    rows.
    """
    one = stored(items.filter(F.col(text) != "").groupBy(F.xxhash64(text).alias("_i")).agg(F.first(text).alias("_it")).withColumn("_len", F.pow(F.lit(2), F.least(F.lit(4), F.floor(F.log2(F.length("_it"))))).cast("int")))
    few = small_enough(one)
    lengths = sorted(r[0] for r in one.select("_len").distinct().collect())  # five at most
    grams = lambda c, n: F.explode(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))).alias("_g")
    out = None
    for n in lengths:
        mine = one.filter(F.col("_len") == n).select("_i", grams(F.col("_it"), n)).select("_i", F.xxhash64("_g").alias("_g")).distinct()
        known = mine.select("_g").distinct()
        hits = docs.select(doc_id, grams(F.col(text), n)).select(doc_id, F.xxhash64("_g").alias("_g"))
        hits = stored(hits.join(F.broadcast(known) if small_enough(known) else known, "_g", "left_semi").distinct())
        held = hits.groupBy("_g").agg(F.count("*").alias("_df"))
        anchors = mine.join(held, "_g", "left").groupBy("_i").agg(F.min_by("_g", F.struct(F.coalesce("_df", F.lit(0)), "_g")).alias("_g"))
        found = hits.join(F.broadcast(anchors) if few else anchors, "_g").select(doc_id, "_i")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.limit(0).join(items.select(item_id).limit(0)).select(doc_id, item_id)
    found = stored(out)
    rows = docs.select(doc_id, text).join(F.broadcast(found) if small_enough(found) else found, doc_id)
    rows = rows.join(F.broadcast(one.select("_i", "_it")) if few else one.select("_i", "_it"), "_i").filter(F.contains(F.col(text), F.col("_it"))).select(doc_id, "_i").distinct()
    ids = items.filter(F.col(text) != "").select(item_id, F.xxhash64(text).alias("_i"))
    return rows.join(F.broadcast(ids) if few else ids, "_i").select(doc_id, item_id)


def match_controls(experiment: DataFrame, pool: DataFrame, tokens: str, identity: str, tolerance: int = 10, rounds: int = 100) -> DataFrame:
    """Pool rows matched to the experiment's lengths without replacement, then swapped until the totals agree within ``tolerance``.

    Greedy and sequential: longest first, each takes the nearest length left or right, ties by identity; then the swap that
    brings the total nearest, up to ``rounds`` times. Only (identity, tokens) go to the one task; columns of the pool come back.
    """
    e = experiment.select(F.lit(1).alias("side"), F.lit("").alias("identity"), F.col(tokens).cast("long").alias("tokens"))
    p = pool.select(F.lit(0).alias("side"), F.col(identity).cast("string").alias("identity"), F.col(tokens).cast("long").alias("tokens"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"identity": match(rows.loc[rows.side == 0, ["tokens", "identity"]].values.tolist(), rows.loc[rows.side == 1, "tokens"].tolist(), tolerance, rounds)}, dtype=str)

    chosen = e.unionByName(p).withColumn("all", F.lit(1)).groupBy("all").applyInPandas(solve, "identity string")
    return pool.join(chosen.withColumnRenamed("identity", "_id"), F.col(identity).cast("string") == F.col("_id"), "left_semi")


def match(pool: list[list], wanted: list[int], tolerance: int = 10, rounds: int = 100) -> list[str]:
    """Identities of the rows (tokens, identity) of ``pool`` that :func:`match_controls` takes."""
    from bisect import bisect_left, insort

    free, taken = sorted(map(tuple, pool)), []
    for length in sorted(wanted, reverse=True):
        if not free:
            break
        at = bisect_left(free, (length,))
        near = min((i for i in (at - 1, at) if 0 <= i < len(free)), key=lambda i: (abs(free[i][0] - length), free[i][1]))
        taken.append(free.pop(near))
    total, goal = sum(t for t, _ in taken), sum(wanted)
    for _ in range(rounds):
        if abs(goal - total) <= tolerance or not free:
            break
        swaps = []
        for k, (old, _) in enumerate(taken):
            at = bisect_left(free, (old + goal - total,))
            swaps += [(abs(goal - total + old - free[i][0]), free[i][1], k, i) for i in (at - 1, at, at + 1) if 0 <= i < len(free)]
        if not swaps or (best := min(swaps))[0] >= abs(goal - total):
            break
        _, _, k, i = best
        new, old = free.pop(i), taken[k]
        total += new[0] - old[0]
        taken[k] = new
        insort(free, old)
    return [i for _, i in taken]
