"""Bytes that aren't UTF-8, fingerprints, versioned tables, ordered files, a log that grows."""

import gzip
import hashlib
import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from loomwork.sources import ordered, versions
from loomwork.sources import records as io
from loomwork.streaming import scoring


def test_bad_bytes_go_as_python_drops_them(spark, tmp_path):
    raw = b'{"instruction": "a\xff\xfeb \xef\xbf\xbd \xee\x80\x80\xee\x80\x81 \xe4\xb8"}\n{"instruction": "ok\xc3"}\nbro\xffken\n[1]\n\n{"x": tru}\n{"instruction": "\xed\xa0\x80\xf4\x90\x80\x80z\xc0\xaf\xf0\x9f\x98"}\n{"instruction": "\xf0\x9f\x98\x80"}\n'
    path = tmp_path / "a.jsonl"
    path.write_bytes(raw)
    want, errors = [], {}
    for n, line in enumerate(open(path, encoding="utf-8", errors="ignore"), 1):
        try:
            found = json.loads(line)
            want += [found["instruction"]] if isinstance(found, dict) else []
        except ValueError as e:
            errors[n] = str(e)
    good, bad = io.read_jsonl_quarantined(spark, str(path), io.SFT)
    assert [r.instruction for r in good.orderBy("seq").collect()] == want
    assert sorted(r.instruction for r in io.read_jsonl_dropping(spark, str(path), io.SFT).collect()) == sorted(want)
    got = {r.line_number: (r.raw_line, r.error) for r in bad.collect()}
    assert got == {3: ("broken", "Expecting value: line 1 column 1 (char 0)"), 4: ("[1]", "not an object but list"), 6: ('{"x": tru}', errors[6])}


def test_fingerprints_of_files_in_many_splits(spark, tmp_path):
    files = {"a b.txt": b"one\r\ntwo\n", "empty": b"", "nl": b"\n", "x": b"abc", "bin": os.urandom(300_001), "big": b"".join(b"line %d\n" % i for i in range(60_000)) + b"tail", "two": b"a\n\n", "z.gz": gzip.compress(b"hello\n" * 100)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in io.fingerprints(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in files.items()}


def test_a_reader_always_finds_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda n: spark.range(100).select(F.lit(n).alias("n"))
    assert versions.read(spark, path, df(0).schema).count() == 0
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    assert versions.replace(df(0), path) == 1
    seen, errors, done = [], [], threading.Event()

    def reader():
        while not done.is_set():
            try:
                seen.append([(r.n, r["count"]) for r in versions.read(spark, path).groupBy("n").count().collect()])
            except Exception as e:
                errors.append(e)
                return

    t = threading.Thread(target=reader)
    t.start()
    for n in range(1, 8):
        versions.replace(df(n), path, keep=8)
    done.set()
    t.join()
    assert not errors and len(seen) > 3 and all(len(s) == 1 and s[0][1] == 100 for s in seen)
    assert [s[0][0] for s in seen] == sorted(s[0][0] for s in seen)
    with pytest.raises(versions.Replaced):
        versions.replace(df(9), path, expected=3)
    assert versions.replace(df(9), path, expected=8, keep=2) == 9 and versions.read(spark, path).first().n == 9
    assert [n for n, _ in versions.pointers(spark, path)] == [8, 9] and len([p for p in os.listdir(path) if p.startswith("v-")]) == 2


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    df = spark.range(5)
    versions.replace(df, path)
    found = versions.pointers(spark, path)
    versions.replace(df, path)
    monkeypatch.setattr(versions, "pointers", lambda *a: found)  # as one that looked before the other was done
    with pytest.raises(versions.Replaced):
        versions.replace(df.limit(1), path)
    monkeypatch.undo()
    assert versions.read(spark, path).count() == 5


def test_order_of_files_is_the_order_of_keys(spark, tmp_path):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("k"))
    out = ordered.write_ordered(df, str(tmp_path / "o"), F.sha2(F.col("id").cast("string"), 256), file_rows=700)
    rows = out.orderBy("number").collect()
    assert len(rows) == 8 and [r.before for r in rows] == [sum(x.rows for x in rows[:i]) for i in range(8)] and max(r.rows for r in rows) < 1400
    got = ordered.read_ordered(spark, str(tmp_path / "o"))
    assert got.columns == ["id", "k", "seq"]
    want = sorted(range(5000), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())
    assert [r.id for r in got.orderBy("seq").collect()] == want and got.agg(F.max("seq")).first()[0] == 4999
    files = [want[r.before : r.before + r.rows] for r in rows]
    assert [[x.id for x in spark.read.parquet(str(tmp_path / "o" / "data" / r.file)).collect()] for r in rows] == files
    ties = ordered.write_ordered(df, str(tmp_path / "p"), F.lit(1), file_rows=700)
    assert ties.count() == 8 and ordered.read_ordered(spark, str(tmp_path / "p")).select("seq").distinct().count() == 5000
    assert ordered.write_ordered(df.limit(0), str(tmp_path / "q"), F.lit(1)).count() == 0 and ordered.read_ordered(spark, str(tmp_path / "q")).count() == 0


def test_stored_tables_go_on_request(spark):
    from loomwork.operators import store

    small, held = store.held(spark.range(5))
    large, kept = store.held(spark.range(5), 2)
    assert held and not kept and small.count() == large.count() == 5
    folder = f"{store.shared_folder(spark)}/loomwork-{spark.sparkContext.applicationId}"
    assert io.exists(spark, folder)
    store.drop_stored(spark)
    assert not io.exists(spark, folder)


def test_a_line_that_is_appended_later_is_seen(spark, tmp_path):
    log = tmp_path / "train.log"
    calls = []
    writer = threading.Thread(target=lambda: [time.sleep(2), log.write_text("step 299/300\n"), time.sleep(3), log.open("a").write("step 300/300\n")])
    writer.start()
    assert scoring.watch_log(spark, str(log), r"step.*300/", lambda: calls.append(1), timeout=60, every=0.5) and calls == [1]
    writer.join()
    assert not scoring.watch_log(spark, str(log), "never", lambda: calls.append(2), timeout=3, every=0.5) and calls == [1]
    assert not [q for q in spark.streams.active if q.isActive]
