"""Line dedup: explode normalised lines, hash them, count distinct documents per hash, drop lines over the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import doc_key, skew_safe_lookup, staged

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, min_chars: int = 10, min_docs: int = 2, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` without the lines that other documents hold too, and with n_lines and n_dropped (long), or other names in ``counts``.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and in lower case (A-Z). A key of ``min_chars`` code
    points or more that ``min_docs`` documents or more hold loses all its lines except those of the smallest doc_id that
    holds it; there, every repeat stays. Other lines stay, joined by newlines; a text that loses all of them is empty.

    A null or empty text is one empty line and comes back as the empty text. Rows of one doc_id are one document; a null
    doc_id counts as the largest. Repeated rows all come back. An empty table gives an empty result. Extra columns pass
    through; columns with the names of the counts are replaced. A text of any length is split whole, in the task that holds its row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(doc_key().alias("_ld_doc"), F.xxhash64(text).alias("_ld_th"), F.posexplode(F.split(text, "\n", -1)).alias("_ld_pos", "_ld_line"))
    key = line_key(F.col("_ld_line"))
    lines = lines.filter(F.length("_ld_line") >= min_chars).select("_ld_doc", "_ld_th", "_ld_pos", key.alias("_ld_key")).filter(F.length("_ld_key") >= min_chars)
    lines = lines.select("_ld_doc", "_ld_th", "_ld_pos", F.xxhash64("_ld_key").alias("_ld_h1"), F.xxhash64(F.lit(1), F.col("_ld_key")).alias("_ld_h2"))
    lines = staged(spark, lines, "lines")
    held = lines.groupBy("_ld_h1", "_ld_h2", "_ld_doc").agg(F.count("*").alias("_ld_n"))
    held = held.groupBy("_ld_h1", "_ld_h2").agg(F.count("*").alias("_ld_docs"), F.sum("_ld_n").alias("_ld_n"), F.min("_ld_doc").alias("_ld_first"))
    held = staged(spark, held.filter(F.col("_ld_docs") >= min_docs), "held-lines")
    found = skew_safe_lookup(lines, held, ["_ld_h1", "_ld_h2"], ["_ld_first"], "_ld_n", ["_ld_doc", "_ld_pos"])
    drop = found.filter(F.col("_ld_doc") > F.col("_ld_first")).groupBy("_ld_doc", "_ld_th").agg(F.collect_set("_ld_pos").alias("_ld_drop"))
    # the input's other columns travel in a struct, whatever their names
    extra = [c for c in docs.columns if c.lower() not in (*counts, "text")]
    held_row = F.struct(*(F.col(f"`{c}`") for c in extra)).alias("_ld_row")
    out = docs.select(doc_key().alias("_ld_doc"), F.xxhash64(text).alias("_ld_th"), text.alias("_ld_text"), held_row).join(drop, ["_ld_doc", "_ld_th"], "left")
    text = F.col("_ld_text")
    split = F.split(text, "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "_ld_drop"), lambda i: F.get(split, i))
    columns = {counts[0]: F.size(split).cast("long"), counts[1]: F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("long"), "text": F.when(F.col("_ld_drop").isNull(), text).otherwise(F.array_join(kept, "\n"))}
    return out.select(*(F.col(f"_ld_row.`{c}`") for c in extra), *(v.alias(k) for k, v in columns.items())).select(*(f"`{c}`" for c in dict.fromkeys([*(c for c in docs.columns if c in extra or c.lower() == "text"), *counts])))
