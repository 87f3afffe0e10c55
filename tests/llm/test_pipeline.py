"""The pipeline's stages and this subpackage's SQL on the smallest tables, against plain Python."""

import re

import duckdb
import pytest

import corpus_pipeline as pipeline
from loomwork.llm import queries

DIR = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    rel = duck.sql(queries.SQL[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in order]
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def shingles(text, n=5):
    w = WORDS.findall(text.lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_stages(spark):
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near-dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}

    good = pipeline.quality_rules(spark, docs, DIR)
    assert good.columns == columns
    kept = {r.doc_id for r in queries.QUERIES["op7_quality"](spark, DIR).filter("kept").collect()}
    assert {r.doc_id: r.text for r in good.collect()} == {i: rows[i] for i in kept}

    lines = pipeline.line_dedup(spark, good, DIR)
    assert lines.columns == columns
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert set(texts) == kept and all(r.n_chars == len(r.text) for r in lines.collect())

    # near copies of the documents as they came, so that there are some
    sets = {i: shingles(t) for i, t in rows.items()}
    ids = sorted(rows)
    left = {r.doc_id for r in pipeline.near_dedup(spark, docs, DIR).collect()}
    for n, i in enumerate(ids):
        twins = [j for j in ids if j != i and similar(sets[i], sets[j]) >= 0.8]
        if not any(similar(sets[i], sets[j]) >= 0.5 for j in ids if j != i):
            assert i in left
        if any(j < i for j in twins):
            assert i not in left, (i, n, twins)

    bench = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    clean = pipeline.decontamination(spark, docs, DIR)
    assert clean.columns == columns
    leaks = {i for i, t in rows.items() if any(norm(b) in norm(t) for b in bench)}
    gone = set(ids) - {r.doc_id for r in clean.collect()}
    assert leaks <= gone and len(gone) <= len(leaks) + 3

    packed = pipeline.packing(spark, lines, DIR)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept


def test_run(spark):
    out = pipeline.run(spark, DIR)
    assert out.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(out.columns)
