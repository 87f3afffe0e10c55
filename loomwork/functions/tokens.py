"""Token arrays: a default pre-tokenizer, lengths, label masks, padding. Another tokenizer is a function from Column to array Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwork.functions.text import _col, instruction_prefix

Tokenizer = Callable[[Column], Column]
IGNORED = -100


def tokens(c: Column | str) -> Column:
    """Runs of letters and digits, and single other characters but white space."""
    return F.regexp_extract_all(_col(c), F.lit(r"([\p{L}\p{N}]+|[^\s\p{L}\p{N}])"), F.lit(1))


def token_length(c: Column | str, tokenizer: Tokenizer = tokens) -> Column:
    return F.size(tokenizer(_col(c)))


def token_counts(text: Column, prefix: Column, tokenizer: Tokenizer = tokens) -> Column:
    """(full, supervised): tokens of the text, and of what follows the prefix."""
    n = token_length(text, tokenizer)
    return F.struct(n.alias("full"), (n - token_length(prefix, tokenizer)).alias("supervised"))


def label_mask(ids: Column, prefix_length: Column, least: int = 10) -> Column:
    """Ids with the first ``prefix_length`` ignored; null (skip the row) if nothing is left, or under ``least`` ids."""
    keep = (prefix_length < F.size(ids)) & (F.size(ids) >= least)
    return F.when(keep, F.concat(F.array_repeat(F.lit(IGNORED), prefix_length), F.slice(ids, prefix_length + 1, F.size(ids))))


def sft_labels(df: DataFrame, text: Column, ids: Callable[[Column], Column], instruction: str = "instruction") -> DataFrame:
    """``df`` with input_ids and labels; rows that :func:`label_mask` skips go."""
    out = df.withColumns({"input_ids": ids(text), "_p": F.size(ids(instruction_prefix(instruction)))})
    return out.withColumn("labels", label_mask(F.col("input_ids"), F.col("_p"))).drop("_p").filter("labels IS NOT NULL")


def pad_batches(df: DataFrame, batch: Column, pad_id: int = 0, max_length: int = 2048) -> DataFrame:
    """``df`` (input_ids, labels) with both, and attention_mask, as long as the longest row of the batch, ``max_length`` at most."""
    width = F.least(F.max(F.size("input_ids")).over(W.partitionBy("_batch")), F.lit(max_length))
    out = df.withColumn("_batch", batch).withColumn("_w", width)
    n = F.least(F.size("input_ids"), F.col("_w"))
    fill = lambda c, value: F.concat(F.slice(F.col(c), F.lit(1), n), F.array_repeat(F.lit(value), F.col("_w") - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.col("_w") - n))
    return out.select(*(c for c in df.columns if c not in ("input_ids", "labels")), F.col("_batch").alias("batch"), fill("input_ids", pad_id).alias("input_ids"), fill("labels", IGNORED).alias("labels"), mask.alias("attention_mask"))


def response_mask(attention: Column, prompt_length: Column) -> Column:
    return F.transform(attention, lambda x, i: F.when((i >= prompt_length) & (x == 1), 1).otherwise(0))


def breaks_tags(toks: Column, max_length: int = 2048) -> Column:
    """Whether cutting at ``max_length`` tokens loses a closing tag of the default tokenizer's text."""
    cut = F.array_join(F.slice(toks, 1, max_length), "")
    return (F.size(toks) > max_length) & ~(cut.contains("</think>") & cut.contains("</answer>"))
