"""All queries of the library's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, fractions rounded to six places."""
    cast = {"tinyint": "long", "smallint": "long", "int": "long", "array<int>": "array<bigint>"}
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        cols.append(c.cast(cast[kind]).alias(name) if kind in cast else F.round(c.cast("double"), 6).alias(name) if kind in ("double", "float") or kind.startswith("decimal") else c)
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); its result is tidied."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from loomwork.plans import cleaning, evaluation, ingest, ledgers, process, selection  # noqa: F401


load()
