"""Filters that say why: a row keeps a reason, and one frame splits into accepted and rejected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import balanced_boxes, has_control_char, last, strip


def required_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with missing_fields and reject_reason (missing_required_text or null)."""
    blank = lambda c: F.col(c).isNull() | (strip(c) == "")
    missing = F.array_compact(F.array(*(F.when(blank(c), F.lit(c)) for c in columns)))
    return df.withColumn("missing_fields", missing).withColumn("reject_reason", F.when(F.size("missing_fields") > 0, "missing_required_text"))


def allowed(df: DataFrame, by: str, allow: list[str] | None = None, deny: list[str] = ()) -> DataFrame:
    """Rows whose category is in ``allow`` (any, if None) and not in ``deny``; a null one passes only without an allow-list."""
    out = df if allow is None else df.filter(F.col(by).isin(*allow))
    return out.filter(F.col(by).isNull() | ~F.col(by).isin(*deny)) if deny else out


def max_length(df: DataFrame, tokens: Column, limit: int, name: str = "sft_token_length") -> DataFrame:
    """``df`` with the token length and, unless there is a reason already, too_long where it exceeds the limit."""
    own = F.coalesce("reject_reason", F.when(F.col(name) > limit, F.lit("too_long"))) if "reject_reason" in df.columns else F.when(F.col(name) > limit, F.lit("too_long"))
    return df.withColumn(name, tokens).withColumn("reject_reason", own)


def fail_if_longer(df: DataFrame, tokens: Column, limit: int) -> DataFrame:
    """``df``; the query fails at a row over the limit."""
    return df.withColumn("_ok", F.assert_true(tokens <= limit, F.concat(F.lit("a row is over the limit: "), tokens.cast("string")))).filter("_ok IS NULL").drop("_ok")


def box_consistency(df: DataFrame, reasoning: str = "reasoning", answer: str = "answer") -> DataFrame:
    """``df`` with reasoning_last_box and finalize_status: rejected where that box is there and differs from the answer."""
    box = last(F.filter(balanced_boxes(reasoning), lambda b: b != ""))
    return df.withColumn("reasoning_last_box", box).withColumn("finalize_status", F.when(F.col("reasoning_last_box") != strip(answer), "rejected").otherwise("accepted"))


def strictly_valid(verifier: str = "verifier") -> Column:
    """True only where the verifier says so in all three fields."""
    v = F.col(verifier)
    return v["valid"].eqNullSafe(F.lit(True)) & v["supports_answer"].eqNullSafe(F.lit(True)) & v["missing_key_step"].eqNullSafe(F.lit(False))


def long_probe(df: DataFrame, token_length: Callable[[Column], Column], incomplete: Column, min_chars: int = 4000, cap: int = 2048, gold: str = "reliable_answer") -> DataFrame:
    """Rows worth a longer generation: a long gold reasoning, an incomplete prediction that ran into the ``cap`` of tokens, and a reliable gold answer.

    Adds gold_reasoning_chars and generated_tokens, those from ``<think>`` on.
    """
    text = F.coalesce("prediction", F.lit(""))
    generated = F.when(text.contains("<think>"), F.expr("substring(coalesce(prediction, ''), instr(coalesce(prediction, ''), '<think>'))")).otherwise(text)
    out = df.withColumns({"gold_reasoning_chars": F.length("reasoning"), "generated_tokens": token_length(generated)})
    return out.filter((F.col("gold_reasoning_chars") >= min_chars) & incomplete & (F.col("generated_tokens") >= cap) & F.col(gold).isNotNull())


def reasons(df: DataFrame, rules: dict[str, Column], name: str = "reasons") -> DataFrame:
    """``df`` with all reasons that hold, in order."""
    return df.withColumn(name, F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items()))))


def synthesis_rules(full: str, supervised: str, limit: int = 2048) -> dict[str, Column]:
    """Reasons against an accepted synthesis, but for those that need other rows."""
    box = last(F.filter(balanced_boxes("reasoning"), lambda b: b != ""))
    return {
        "unsupported_control_character": has_control_char("instruction") | has_control_char("reasoning") | has_control_char("answer"),
        "reasoning_box_answer_mismatch": F.coalesce(box != strip("answer"), F.lit(False)),
        "verifier_not_strictly_valid": ~strictly_valid(),
        "formatted_too_long": F.col(full) > limit,
        "empty_supervision": F.col(supervised) <= 0,
    }


def split(df: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of one frame."""
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())
