"""Structured Streaming forms. The reference has none of them; they are additions, but for resuming and the log watcher."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resume(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Everything in ``source`` that no earlier call has handled, transformed and appended to ``out``; then it ends."""
    rows = spark.readStream.schema(schema).format(fmt).load(source)
    return transform(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored_events(events: DataFrame) -> DataFrame:
    """A stateless score of each event: its value's band and the number in its properties."""
    band = F.when(F.col("value") < 10, "low").when(F.col("value") < 100, "mid").otherwise("high")
    return events.select("event_id", "user_id", "event_type", band.alias("band"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def first_seen(rows: DataFrame, key: str, at: str, within: str = "1 hour") -> DataFrame:
    """Rows of a stream whose key was not seen ``within`` that time before; state older than the watermark goes."""
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def watch_log(spark: SparkSession, path: str, pattern: str, found: Callable[[], None], timeout: float, every: float = 1.0) -> bool:
    """Waits until a line of the log files at ``path`` matches, calls ``found`` and returns True; False after ``timeout`` seconds.

    A file source takes a file once and misses what is appended, so a clock drives the query: each tick reads the files again
    if their number or size has changed. The files may not be there yet. The batch that sees the line ends the query.
    """
    seen = threading.Event()
    state = {"size": None}

    def look(tick: DataFrame, _: int) -> None:
        session = tick.sparkSession
        at = session._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(session._jsc.hadoopConfiguration())
        files = fs.globStatus(at) or []
        files = [f for s in files for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
        size = (len(files), sum(f.getLen() for f in files))
        if seen.is_set() or not files or size == state["size"]:
            return
        state["size"] = size
        if session.read.text(path).filter(F.col("value").rlike(pattern)).limit(1).count():
            seen.set()

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    query = clock.writeStream.foreachBatch(look).trigger(processingTime=f"{int(1000 * every)} milliseconds").start()
    try:
        end = time.monotonic() + timeout
        while not seen.wait(min(0.2, max(0.0, end - time.monotonic()))):
            if time.monotonic() >= end or not query.isActive:
                break
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()
    if seen.is_set():
        found()
    return seen.is_set()
