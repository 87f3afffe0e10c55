"""Completeness, error taxonomies, rewards and objectives as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.answers import check_correct, normalize_answer
from loomwork.functions.text import _col, answer_or_last_line, sentence_count, tag, think_text

#: Labels of the error classes.
ERRORS = ("正确", "格式错误", "跳步", "计算错误", "语义误解")


def completeness(c: Column | str = "prediction") -> Column:
    """complete, or the first defect."""
    p = F.coalesce(_col(c), F.lit(""))
    return F.when(~p.contains("</think>"), "no_</think>").when(~p.contains("<answer>"), "no_<answer>").when(~p.contains("</answer>"), "no_</answer>").when(F.coalesce(tag(p, "answer"), F.lit("")) == "", "empty_answer").otherwise("complete")


def tagged_correct(pred: Column | str = "prediction", gold: Column | str = "answer", form: str = "full") -> Column:
    """Whether there is a non-empty answer tag and it is right."""
    a = tag(pred, "answer")
    return F.coalesce(a != "", F.lit(False)) & check_correct(a, gold, form)


def error_class(pred: Column | str = "prediction", gold: Column | str = "answer") -> Column:
    """Right, bad format, skipped steps, miscalculation or misreading; the answer may be the last line."""
    p = _col(pred)
    answer = answer_or_last_line(p)
    right = check_correct(answer, gold)
    return F.when(right, ERRORS[0]).when(~p.rlike("(?s)<think>(.*?)</think>"), ERRORS[1]).when(sentence_count(p) < 3, ERRORS[2]).when(normalize_answer(answer).rlike(r"\d"), ERRORS[3]).otherwise(ERRORS[4])


def comparison_class(pred: Column | str = "prediction", gold: Column | str = "answer") -> Column:
    """correct, truncated (both closing tags missing), no_answer or wrong."""
    p = _col(pred)
    right = check_correct(tag(p, "answer"), gold)
    return F.when(right, "correct").when(~p.contains("</think>") & ~p.contains("</answer>"), "truncated").when(~p.contains("</answer>"), "no_answer").otherwise("wrong")


def badcase_class(pred: Column | str = "prediction", gold: Column | str = "answer") -> Column:
    """truncated, correct, calc or semantic."""
    p = _col(pred)
    a = tag(p, "answer")
    return F.when(~p.contains("</think>") | a.isNull(), "truncated").when(check_correct(a, gold, "badcase"), "correct").when(normalize_answer(a, "badcase").rlike(r"\d"), "calc").otherwise("semantic")


def mining_class(pred: Column | str = "prediction", gold: Column | str = "answer") -> Column:
    """truncated, correct_complete or wrong_complete."""
    return F.when(completeness(pred) != "complete", "truncated").when(tagged_correct(pred, gold), "correct_complete").otherwise("wrong_complete")


def length_bucket(tokens: Column | str) -> Column:
    t = F.coalesce(_col(tokens), F.lit(0))
    return F.when(t <= 4096, "2049-4096").when(t <= 8192, "4097-8192").otherwise(">8192")


def reject_category(c: Column | str) -> Column:
    r = F.coalesce(F.when(_col(c) != "", _col(c)), F.lit("unknown"))
    for name in ("teacher_rejected", "verifier_rejected", "api_or_parse_error"):
        r = F.when(r.startswith(name), name).otherwise(r)
    return F.substring_index(r, ":", 1)


def _tiers(length: Column, tiers: tuple[tuple[int, float], ...], last: float) -> Column:
    out = F.when(length < tiers[0][0], tiers[0][1])
    for below, value in tiers[1:]:
        out = out.when(length < below, value)
    return out.otherwise(last)


def reward_v1(pred: Column | str = "prediction", gold: Column | str = "answer", accuracy: float = 0.7, completeness: float = 0.2, efficiency: float = 0.1) -> Column:
    """(total, accuracy, completeness, efficiency, think_len); right answers earn by length, wrong ones half."""
    p = _col(pred)
    n = F.length(think_text(p))
    right = tagged_correct(p, gold, "reward")
    acc = F.when(right, 1.0).otherwise(0.0)
    comp = F.when(~p.contains("</think>"), 0.0).when(p.contains("</answer>"), 1.0).otherwise(0.5)
    # Lengths and efficiencies.
    eff = F.when(n == 0, 0.0).when(right, _tiers(n, ((200, 0.5), (1500, 1.0), (2500, 0.7)), 0.3)).otherwise(0.5)
    total = accuracy * acc + completeness * comp + efficiency * eff
    return F.struct(total.alias("total"), acc.alias("accuracy"), comp.alias("completeness"), eff.alias("efficiency"), n.alias("think_len"))


def reward_v2(pred: Column | str = "prediction", gold: Column | str = "answer", accuracy: float = 0.6, completeness: float = 0.15, efficiency: float = 0.25) -> Column:
    """As :func:`reward_v1` with nothing for a cut-off answer, a bonus for short right ones, and the total held to [0, 1]."""
    p = _col(pred)
    n = F.length(think_text(p))
    cut = ~p.contains("</answer>")
    right = tagged_correct(p, gold, "reward") & ~cut
    acc = F.when(right, 1.0).otherwise(0.0)
    comp = F.when(cut, F.when(p.contains("</think>"), 0.3).otherwise(0.0)).when(p.contains("</think>"), 1.0).otherwise(0.0)
    # Lengths, efficiencies and bonuses.
    eff = F.when(cut | (n == 0), 0.0).otherwise(_tiers(n, ((200, 0.3), (800, 1.0), (1500, 0.65), (2500, 0.3)), 0.05))
    bonus = F.when(right & (n > 0), _tiers(n, ((500, 0.15), (1000, 0.08)), 0.0)).otherwise(0.0)
    total = F.when(cut, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), accuracy * acc + completeness * comp + efficiency * eff + bonus)))
    return F.struct(total.alias("total"), acc.alias("accuracy"), comp.alias("completeness"), eff.alias("efficiency"), bonus.alias("bonus"), n.alias("think_len"), cut.alias("is_truncated"))


def process_reward(scores: Column, accuracy: Column, complete: Column) -> Column:
    """(total, accuracy, completeness, efficiency, prm_score) from an array of step scores; no steps: all zero."""
    n = F.size(scores)
    mean = array_mean(scores)
    eff = F.when(n <= 3, 0.3).when(n <= 8, 1.0 - 0.5 * (n - 3) / 5).otherwise(0.5)
    comp = F.when(complete, 1.0).otherwise(0.0)
    none = n == 0
    zero = lambda c: F.when(none, 0.0).otherwise(c)
    return F.struct(zero(0.7 * mean + 0.2 * accuracy + 0.1 * eff).alias("total"), zero(accuracy).alias("accuracy"), zero(comp).alias("completeness"), zero(eff).alias("efficiency"), zero(mean).alias("prm_score"))


def array_mean(a: Column) -> Column:
    """Mean, added up from the last element on: the order in which the queries' SQL meets them, so means at an edge fall on the same side."""
    return F.aggregate(F.reverse(a), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))


def array_std(a: Column) -> Column:
    """Population standard deviation, by one pass from the last element on (see :func:`array_mean`)."""

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    return F.sqrt(F.aggregate(F.reverse(a), start, step)["squares"] / F.nullif(F.size(a), F.lit(0)))


def ppo_loss(new: Column, old: Column, ref: Column, advantage: Column, clip: float = 0.2, beta: float = 0.04) -> Column:
    """Clipped objective, negated, with a penalty for leaving the reference."""
    ratio = F.exp(new - old)
    held = F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), ratio))
    return -F.least(ratio * advantage, held * advantage) + beta * (ref - new)


def token_cost(hit: Column, miss: Column, output: Column, prices: tuple[float, float, float]) -> Column:
    """Cost at prices per million tokens."""
    return sum((tokens / 1_000_000 * price for tokens, price in zip((hit, miss, output), prices, strict=True)), F.lit(0.0))
