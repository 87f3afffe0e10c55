"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwork.llm.common import doc_key, staged

#: Slots never change; only the map from slot to shard is edited.
N_SLOTS = 4096


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of each row. The slot hashes doc_id and text, so rows without an id and copies of one id spread too."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_slots)).cast("int").alias("virtual_slot"))


def slot_bytes(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) of every slot, those without rows too: ``n_slots`` rows."""
    used = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(used, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def _least(loads: Column) -> Column:
    """Number of the first least loaded shard."""
    return (F.array_position(loads, F.array_min(loads)) - 1).cast("int")


def _put(loads: Column, shard: Column, more: Column) -> Column:
    return F.transform(loads, lambda x, i: F.when(i == shard, x + more).otherwise(x))


def first_map(slots: DataFrame, n_shards: int) -> DataFrame:
    """Version 1 of the map (version, virtual_slot, shard): slots by falling bytes, each to the least loaded shard.

    A fold over one array of all slots, whose number is fixed whatever the input.
    """
    order = F.reverse(F.array_sort(F.collect_list(F.struct("bytes", "virtual_slot"))))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("map"))

    def step(state: Column, slot: Column) -> Column:
        shard = _least(state["loads"])
        return F.struct(_put(state["loads"], shard, slot["bytes"]).alias("loads"), F.array_append(state["map"], F.struct(slot["virtual_slot"].alias("virtual_slot"), shard.alias("shard"))).alias("map"))

    folded = slots.agg(F.aggregate(order, start, step)["map"].alias("map"))
    return folded.select(F.inline("map")).select(F.lit(1).alias("version"), "virtual_slot", "shard")


def rebalanced_map(old: DataFrame, slots: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map for ``n_shards`` shards: slots stay where they are until their shard is full.

    A shard keeps its slots, by falling bytes, while they fit in an equal share of all bytes; the others go to the least
    loaded shards. So a new or emptied shard takes slots and no other slot moves for nothing. Slots of shards that are gone
    (number ``n_shards`` or above) all move.
    """
    now = old.groupBy().agg(F.max("version")).first()[0]
    held = slots.join(old.filter(F.col("version") == now), "virtual_slot")
    order = F.reverse(F.array_sort(F.collect_list(F.struct("bytes", "virtual_slot", "shard"))))
    share = F.ceil(F.sum("bytes") / n_shards)
    one = "struct<bytes:bigint,virtual_slot:int,shard:int>"
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"), F.array().cast(f"array<{one}>").alias("map"), F.array().cast(f"array<{one}>").alias("rest"))

    def keep(share: Column):
        def step(state: Column, slot: Column) -> Column:
            fits = F.coalesce((slot["shard"] < n_shards) & (F.get(state["loads"], slot["shard"]) + slot["bytes"] <= share), F.lit(False))
            return F.struct(F.when(fits, _put(state["loads"], slot["shard"], slot["bytes"])).otherwise(state["loads"]).alias("loads"), F.when(fits, F.array_append(state["map"], slot)).otherwise(state["map"]).alias("map"), F.when(fits, state["rest"]).otherwise(F.array_append(state["rest"], slot)).alias("rest"))

        return step

    def deal(state: Column, slot: Column) -> Column:
        shard = _least(state["loads"])
        return F.struct(_put(state["loads"], shard, slot["bytes"]).alias("loads"), F.array_append(state["map"], F.struct(slot["bytes"].alias("bytes"), slot["virtual_slot"].alias("virtual_slot"), shard.alias("shard"))).alias("map"))

    kept = held.agg(order.alias("slots"), share.alias("share")).select(F.aggregate("slots", start, keep(F.col("share"))).alias("s"))
    dealt = kept.select(F.aggregate(F.col("s.rest"), F.struct(F.col("s.loads").alias("loads"), F.col("s.map").alias("map")), deal)["map"].alias("map"))
    return dealt.select(F.inline("map")).select(F.lit(now + 1).alias("version"), "virtual_slot", "shard")


def next_map(spark: SparkSession, docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, versions: DataFrame | None = None) -> DataFrame:
    """All versions of the map, the next one for the bytes of ``docs`` among them, as a stored table.

    Without ``versions`` (or with an empty one) that is version 1 (:func:`first_map`); else the last one is edited
    (:func:`rebalanced_map`), so slots move only where a shard has outgrown its share, is new or is gone.
    """
    return _next(spark, staged(spark, slot_bytes(with_slots(docs, n_slots), n_slots), "slot-bytes"), n_shards, versions)


def _next(spark: SparkSession, slots: DataFrame, n_shards: int, versions: DataFrame | None) -> DataFrame:
    if versions is None or not versions.limit(1).count():
        return staged(spark, first_map(slots, n_shards), "slot-map")
    return staged(spark, versions.unionByName(rebalanced_map(versions, slots, n_shards)), "slot-map")


def shard_documents(spark: SparkSession, docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, versions: DataFrame | None = None) -> DataFrame:
    """Every row of ``docs`` with its shard: doc_id, size, text_crc32, virtual_slot, version, shard, slot (its place in the shard).

    ``versions``: a map to go by, as :func:`next_map` returns and edits it; its last version holds as it is. None: a first
    map is made. Size is the text's UTF-8 bytes plus 1; a null text has none and crc32 0. By a new map shards differ in bytes
    by little more than the smallest slot, unless one slot alone exceeds a share. Repeated rows and rows without an id each
    get a place of their own; ties in doc_id within a slot are broken by size and crc32 (equal rows in any order). A text of
    any length is one row; only its size and checksum travel. An empty table gives an empty result.
    The documents are read once; only their ids, sizes and checksums are stored and shuffled. The map is stored in the shared folder and joined by broadcast: it has
    ``n_slots`` rows a version whatever the input.
    """
    rows = staged(spark, with_slots(docs, n_slots), "slot-rows")
    counts = staged(spark, slot_bytes(rows, n_slots), "slot-bytes")
    versions = _next(spark, counts, n_shards, None) if versions is None else versions
    now = versions.groupBy().agg(F.max("version")).first()[0]
    placed = versions.filter(F.col("version") == now).join(counts, "virtual_slot")
    before = F.sum("rows").over(W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1))
    placed = placed.select("virtual_slot", "shard", "version", F.coalesce(before, F.lit(0)).alias("_first"))
    at = F.row_number().over(W.partitionBy("virtual_slot").orderBy(doc_key(), "size", "text_crc32"))
    return rows.withColumn("_at", at).join(F.broadcast(placed), "virtual_slot").select("doc_id", "size", "text_crc32", "virtual_slot", "version", "shard", (F.col("_first") + F.col("_at") - 1).alias("slot"))
