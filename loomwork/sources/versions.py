"""Tables that are replaced as a whole: versioned folders, and pointers of which the last one counts.

A table's folder holds ``v-…`` folders with data and ``_pointers`` with numbered files, each the name of a version. A pointer
is made complete beside the others and renamed to a number that is free; that is the one step that readers notice. Nothing
that a reader may have found is changed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Replaced(Exception):
    """Another writer has replaced the table since its last version was looked up."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) in order; empty if there is no table."""
    fs, folder = _path(spark, f"{path}/_pointers")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names if n[:1].isdigit())


def replace(df: DataFrame, path: str, expected: int | None = None, keep: int = 2) -> int:
    """Write ``df`` as the table's next version; its number.

    ``expected``: the number that the new version is built on; :class:`Replaced` if another came after it. Of two writers of
    one number one gets it, the other :class:`Replaced`. Versions before the last ``keep`` go, so a reader has that many
    replacements' time to finish.
    """
    spark = df.sparkSession
    last = pointers(spark, path)
    number = 1 + (last[-1][0] if last else 0)
    if expected is not None and expected != number - 1:
        raise Replaced(f"{path} is at {number - 1}, not at {expected}")
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    fs, folder = _path(spark, f"{path}/_pointers")
    fs.mkdirs(folder)
    # the number alone is claimed: of two files of that number one is made
    _, claim = _path(spark, f"{path}/_pointers/.claim-{number:012d}")
    if not fs.createNewFile(claim):
        fs.delete(_path(spark, f"{path}/{version}")[1], True)
        raise Replaced(f"{path} has a version {number}")
    _, temp = _path(spark, f"{path}/_pointers/.new-{uuid.uuid4().hex}")
    fs.create(temp, False).close()
    fs.rename(temp, _path(spark, f"{path}/_pointers/{number:012d}-{version}")[1])
    for old, name in last[: -(keep - 1)] if keep > 1 else last:
        fs.delete(_path(spark, f"{path}/_pointers/{old:012d}-{name}")[1], False)
        fs.delete(_path(spark, f"{path}/_pointers/.claim-{old:012d}")[1], False)
        fs.delete(_path(spark, f"{path}/{name}")[1], True)
    return number


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The last version; without any, no rows of ``schema`` (an error if that isn't given)."""
    found = pointers(spark, path)
    if not found:
        if schema is None:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/{found[-1][1]}")
