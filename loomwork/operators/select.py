"""Dedup, quotas, budgets, splits and interleaving. Order comes from a sequence column or from SHA-256 keys, never from partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwork.operators.cuts import fixed_goal, mark


def _at(order: list[Column], by: list[str]) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(*order))


def first_by(df: DataFrame, by: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_rn", _at([F.col(o) if isinstance(o, str) else o for o in order], by)).filter(F.col("_rn") <= n).drop("_rn")


def best_of_group(df: DataFrame, group: str, answer: str, order: list[Column]) -> DataFrame:
    """``df`` with dedup_status: kept for the first of each group, internal_duplicate for others, duplicate_conflicting_answers for groups with several answers.

    One window over the group, so its key is worked out once.
    """
    whole = W.partitionBy(group)
    many = F.min(answer).over(whole) != F.max(answer).over(whole)
    status = F.when(many, "duplicate_conflicting_answers").when(_at(order, [group]) == 1, "kept").otherwise("internal_duplicate")
    return df.withColumn("dedup_status", status)


def first_claims(df: DataFrame, key: str, seq: str, reasons: str, label: str = "internal_duplicate") -> DataFrame:
    """Adds ``label`` to the reasons of rows whose key an earlier row without reasons holds.

    The first row without other reasons claims a key; any later row of that key is a duplicate, valid otherwise or not.
    """
    claim = F.min(F.when(F.size(reasons) == 0, F.col(seq))).over(W.partitionBy(key))
    again = F.coalesce(F.col(seq) > F.col("_claim"), F.lit(False))
    out = df.withColumn("_claim", claim)
    return out.withColumn(reasons, F.when(again, F.array_append(reasons, F.lit(label))).otherwise(F.col(reasons))).drop("_claim")


def _quota(by: str, quotas: dict[str, int]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))[F.col(by)], F.lit(0))


def quota_sample(df: DataFrame, by: str, quotas: dict[str, int], key: Column, ties: list[str] | None = None) -> DataFrame:
    """Of each category in ``quotas`` its first rows in key order, as many as its quota or as there are. ``ties``: see :func:`cuts.mark`."""
    rows = df.filter(F.col(by).isin(*quotas))
    return mark(rows, [by], key, fixed_goal(_quota(by, quotas)), ties=ties).filter("_in").drop("_in")


def parse_quotas(items: list[str]) -> dict[str, int]:
    """``SOURCE=COUNT`` items; the last = divides."""
    out = {}
    for item in items:
        name, eq, count = item.rpartition("=")
        if not eq or not name or not count.isdigit():
            raise ValueError(f"not SOURCE=COUNT: {item!r}")
        out[name] = int(count)
    return out


def mining_pool(df: DataFrame, by: str, quotas: dict[str, int], unique: list[str], key: Column) -> DataFrame:
    """Quota sample without repeats of ``unique``, filled from the rest in key order to the quotas' total; fails if there are too few.

    pool_part is quota or fill. Repeats are found by a digest; keys are unique.
    """
    total = sum(quotas.values())
    digest = F.sha2(F.to_json(F.struct(*(F.col(c) for c in unique))), 256)
    rows = mark(df.withColumn("_key", key), [by], "_key", fixed_goal(_quota(by, quotas)), ties=[])
    place = F.concat(F.when(F.col("_in"), "0").otherwise("1"), F.col("_key"))  # the rest comes after all picked rows, whatever its keys
    rows = rows.withColumns({"_digest": digest, "_key": place})
    one = rows.groupBy("_digest").agg(F.min_by(F.struct(*(f"`{c}`" for c in df.columns), "_in", "_key"), "_key").alias("_row")).select("_row.*")
    chosen = mark(one.withColumnRenamed("_in", "_quota"), [], "_key", fixed_goal(total), ties=[]).filter("_in")
    n = chosen.agg(F.assert_true(F.count("*") == total, F.lit("too few unique candidates")).alias("_ok"))
    out = chosen.withColumn("pool_part", F.when(F.col("_quota"), "quota").otherwise("fill"))
    return out.crossJoin(F.broadcast(n)).filter(F.col("_ok").isNull()).select(*df.columns, "pool_part")


def stratified_holdout(df: DataFrame, strata: list[str], target: int, key: Column, ties: list[str] | None = None) -> DataFrame:
    """``df`` with split (validation or train): each stratum gives int(target n_s / n) rows, the largest one more until the target is met."""

    def goal(sizes: DataFrame) -> DataFrame:
        everything = W.partitionBy()  # a row for each stratum
        total = F.sum("_n").over(everything)
        want = F.least(F.lit(target), total)
        base = F.least(F.col("_n"), F.floor(want * F.col("_n") / F.greatest(F.lit(1), total)))
        sizes = sizes.withColumn("_goal", want).withColumn("_base", base)
        spare = F.col("_goal") - F.sum("_base").over(everything)
        open_ = F.sum(F.when(F.col("_base") < F.col("_n"), 1).otherwise(0)).over(everything.orderBy(F.desc("_n"), *strata))
        return sizes.withColumn("_target", F.col("_base") + F.when((F.col("_base") < F.col("_n")) & (open_ <= spare), 1).otherwise(0))

    return mark(df, strata, key, goal, ties=ties).withColumn("split", F.when(F.col("_in"), "validation").otherwise("train")).drop("_in")


def ordered_split(df: DataFrame, key: Column, train: float = 0.95, ties: list[str] | None = None) -> DataFrame:
    """``df`` with split: the first int(train n) rows in key order are train."""
    rows = mark(df, [], key, fixed_goal(F.floor(F.col("_n") * train)), ties=ties)
    return rows.withColumn("split", F.when(F.col("_in"), "train").otherwise("validation")).drop("_in")


def running_budget(df: DataFrame, tokens: str, key: Column, target: Column | int, by: list[str] | None = None, take_one: bool = False, ties: list[str] | None = None) -> DataFrame:
    """Rows in key order while the tokens before them fall short of the target; the row that crosses it is in.

    ``take_one``: rows with no tokens before them are taken even if the target is 0. With ``by`` each group has its own
    budget, which may be an expression over the group's columns, _n (rows) and _total (tokens).
    """
    target = F.lit(target) if isinstance(target, int) else target
    return mark(df, by or [], key, fixed_goal(F.greatest(target, F.lit(1)) if take_one else target), tokens, ties).filter("_in").drop("_in")


def balanced_replay(df: DataFrame, source: str, tokens: str, target: int, source_key: Column, fill_key: Column, ties: list[str] | None = None) -> DataFrame:
    """A budget shared over sources by their tokens, then filled from the rest: replay_part is source or fill."""
    share = F.lit(float(target)) * F.col("_total") / F.greatest(F.lit(1), F.sum("_total").over(W.partitionBy()))  # a row for each source
    rows = mark(df, [source], source_key, fixed_goal(F.bround(share, 0).cast("long")), tokens, ties)
    first, rest = rows.filter("_in").drop("_in"), rows.filter("NOT _in").drop("_in")
    have = first.agg(F.sum(tokens)).first()[0] or 0
    fill = running_budget(rest, tokens, fill_key, target - have, ties=ties)
    return first.withColumn("replay_part", F.lit("source")).unionByName(fill.withColumn("replay_part", F.lit("fill")))


def _turns(df: DataFrame, by: list[str], source: str, order: list[str], key: Column | str, limit: int, ties: list[str] | None) -> DataFrame:
    """The first ``limit`` rows of each group, more than which no queue of that length takes, with turn and source_rank."""
    key = F.col(key) if isinstance(key, str) else key
    rows = mark(df.withColumn("_key", key), by, "_key", fixed_goal(limit), ties=ties).filter("_in")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(source)), F.lit(0)) if order else F.lit(0)
    place = F.when(rank > 0, F.lpad(rank.cast("string"), 6, "0")).otherwise(F.concat(F.lit("~"), F.col(source)))
    return rows.withColumns({"turn": _at([F.col("_key")], by), "source_rank": place}).select(*df.columns, "turn", "source_rank")


def round_robin(df: DataFrame, source: str, order: list[str], key: Column | str, limit: int, ties: list[str] | None = None) -> DataFrame:
    """The first ``limit`` rows taking turns over sources, those of ``order`` first, others by name; adds turn (round) and source_rank."""
    return _turns(df, [source], source, order, key, limit, ties).orderBy("turn", "source_rank").limit(limit)


def failure_share(df: DataFrame, kind: str, source: str, order: list[str], key: str, limit: int, truncation_share: float, ties: list[str] | None = None) -> DataFrame:
    """A queue of ``limit`` failures, a share of them truncated, each kind filling in for the other; sources take turns within a kind."""
    n = df.groupBy().agg(F.count_if(F.col(kind) == "truncated").alias("_t"), F.count_if(F.col(kind) == "wrong_complete").alias("_w"))
    want = F.least(F.bround(F.lit(limit * truncation_share), 0).cast("long"), F.col("_t"))
    wrong = F.least(F.lit(limit) - want, F.col("_w"))
    cut = F.least(F.lit(limit) - wrong, F.col("_t"))
    limits = n.select(cut.alias("_cut"), wrong.alias("_wrong"))
    rows = _turns(df.filter(F.col(kind).isin("truncated", "wrong_complete")), [kind, source], source, order, key, limit, ties)
    rows = rows.withColumn("_rn", _at([F.col("turn"), F.col("source_rank")], [kind])).crossJoin(F.broadcast(limits))
    return rows.filter(F.col("_rn") <= F.when(F.col(kind) == "truncated", F.col("_cut")).otherwise(F.col("_wrong"))).select(*df.columns)


def advantages(df: DataFrame, group: str, reward: str) -> DataFrame:
    """``df`` with advantage: the reward less its group's mean, over the sample deviation and 1e-8; null for a group of one."""
    w = W.partitionBy(group)
    return df.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_samp(reward).over(w) + 1e-8))


def slice_rows(df: DataFrame, seq: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows in order of ``seq`` after the first ``skip``, ``limit`` of them at most."""
    out = df.orderBy(seq).offset(skip)
    return out if limit is None else out.limit(limit)
