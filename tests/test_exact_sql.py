"""Results at the edges of floats and of Unicode, as DuckDB has them."""

import duckdb
from pyspark.sql import functions as F

from loomwork.functions import scoring as S
from loomwork.plans import fixtures


def test_means_and_deviations_to_the_last_bit(spark):
    """A mean on a bucket's edge depends on the order in which its parts are added."""
    rows = [[0.01 * (i * k % 101) for i in range(1, n)] for n in range(2, 40) for k in (7, 13, 17, 55)] + [[0.1, 0.5], [0.3], [None, 0.5], []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r array<double>")
    got = df.select("i", S.array_mean(F.col("r")).alias("m"), S.array_std(F.col("r")).alias("s")).orderBy("i").collect()
    c = duckdb.connect()
    for row, r in zip(rows, got, strict=True):
        if None in row or not row:
            assert (r.m, r.s) == (None, None)
        else:
            # rows as an unnested list gives them: from the last on
            want = c.execute("SELECT avg(x), stddev_pop(x) FROM (SELECT unnest(list_reverse(?::DOUBLE[])) AS x)", [row]).fetchone()
            assert (r.m, r.s) == want


def test_capitals_one_to_one(spark):
    """Whether a character has one capital, several or none, claims hold what DuckDB's upper makes of it."""
    odd = [c for i in range(0x110000) if len((c := chr(i)).upper()) > 1]
    texts = ["Straße", "abc ä \U00010428", "", None, *(f"x{c}y{c}" for c in odd)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, instruction string")
    got = [r[0] for r in df.orderBy("i").selectExpr(fixtures.UPPER).collect()]
    c = duckdb.connect()
    assert got == [c.execute("SELECT upper(?)", [t]).fetchone()[0] for t in texts]
