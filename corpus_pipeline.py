"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next one.
All but the last return the columns of ``documents``. run() applies them to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import delete, new_path, scratch
from loomwork.llm.decontam import drop_contaminated
from loomwork.llm.linededup import drop_repeated_lines
from loomwork.llm.packing import pack_documents
from loomwork.llm.quality import keep_good
from loomwork.llm.queries import tokenizer_path
from loomwork.llm.simhash import drop_near_duplicates

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that those before them hold; some may be left without text. n_chars follows the text."""
    mark = "_" * (1 + max(len(c) for c in docs.columns))  # the counts' names are no input column's
    kept = drop_repeated_lines(spark, docs, counts=(f"{mark}lines", f"{mark}dropped"))
    n_chars = F.when(F.col(f"{mark}dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.withColumn("n_chars", n_chars).select(*(f"`{c}`" for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return drop_near_duplicates(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sequences: (doc_id, start, length, doc_tokens, ids, sequence_id, offset)."""
    return pack_documents(spark, docs, tokenizer_path(TOKENIZER))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
#: Near-dedup and decontamination are beyond SQL; tests/llm hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of all stages in a row; what a stage leaves in the shared folder goes when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name.replace(' ', '-')}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
