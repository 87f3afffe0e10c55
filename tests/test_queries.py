"""Every query runs on the smallest tables, and agrees with its SQL where it has some."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: round(v, 5) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list | tuple) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_all_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    if name in entry.oracle_sql():
        rel = duck.sql(entry.oracle_sql()[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert canonical(got, df.columns) == canonical(rel.fetchall(), rel.columns)


def test_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "loomwork"), tmp_path / "loomwork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
