"""Sharding through fixed virtual slots.

Records are hashed into ``SLOTS`` slots for good. Which shard a slot belongs to stands in a
small versioned table; rebalancing edits that table and moves whole slots. Law: shards hold
nearly the same number of bytes. Column expressions only; the slot table has ``SLOTS`` rows
whatever the corpus, so sorting it in one task and broadcasting it are bounded.

Defined results: a null text counts 1 byte, a null id is hashed like any value; rows equal
in id and text share a slot; an empty table gives no rows and a full slot map; texts of any
length are measured whole. Columns named
``shard`` and ``virtual_slot`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlots.llm.common import fresh

SLOTS = 4096
SHARDS = 16


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, text), F.lit(slots)).cast("int")


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus one for a separator."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def slot_sizes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, bytes, n_rows) of every slot, empty ones included."""
    rows = docs.select(
        slot_of(F.col("doc_id"), F.col("text"), slots).alias("slot"), size_of(F.col("text")).alias("bytes")
    )
    filled = rows.groupBy("slot").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_rows"))
    every = docs.sparkSession.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("slot"))
    return every.join(filled, "slot", "left").select(
        "slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def rebalanced(sizes: DataFrame, shards: int = SHARDS, current: DataFrame | None = None) -> DataFrame:
    """(version, slot, shard): the next version of a slot map, or the first one.

    A shard keeps its slots, the largest first, as long as they fit into its equal share of
    all bytes. The others go, the largest first, to the shard with the fewest bytes so far.
    """
    if current is None:
        current = sizes.sparkSession.createDataFrame([], "version int, slot int, shard int")
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    share = F.ceil(F.sum("bytes").over(Window.partitionBy()) / shards)
    version = F.coalesce(F.max("version").over(Window.partitionBy()), F.lit(0)) + 1
    known = (
        sizes.select("slot", "bytes").join(current, "slot", "left")
        .withColumns({"share": share, "version": version})
        .withColumn("filled", F.sum("bytes").over(largest_first))
        .withColumn("stays", F.coalesce((F.col("shard") < shards) & (F.col("filled") <= F.col("share")), F.lit(False)))
    )
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda shard: F.aggregate(
            F.filter("kept", lambda slot: slot["shard"] == shard),
            F.lit(0).cast("bigint"),
            lambda total, slot: total + slot["bytes"],
        ),
    )
    rows = known.groupBy("version").agg(
        F.collect_list(F.when(F.col("stays"), F.struct("slot", "shard", "bytes"))).alias("kept"),
        F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "slot")))).alias("free"),
    ).withColumn("loads", loads)

    def dealt(state: Column, slot: Column) -> Column:
        shard = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        grown = F.transform(state["loads"], lambda load, at: F.when(at == shard, load - slot["less"]).otherwise(load))
        moved = F.struct(slot["slot"].alias("slot"), shard.alias("shard"))
        return F.struct(grown.alias("loads"), F.concat(state["dealt"], F.array(moved)).alias("dealt"))

    start = F.struct(F.col("loads"), F.array().cast("array<struct<slot:int,shard:int>>").alias("dealt"))
    whole = F.concat(
        F.transform("kept", lambda slot: F.struct(slot["slot"].alias("slot"), slot["shard"].alias("shard"))),
        F.aggregate("free", start, dealt, lambda state: state["dealt"]),
    )
    return rows.select("version", F.explode(whole).alias("slot")).select("version", "slot.slot", "slot.shard")


def store_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version to the map table in ``folder``; earlier versions stay readable."""
    slot_map.repartition(1).write.mode("append").partitionBy("version").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the newest if none is named."""
    versions = spark.read.schema("version int, slot int, shard int").parquet(folder)
    if version is None:
        newest = F.max("version").over(Window.partitionBy())
        return versions.withColumn("newest", newest).where("version = newest").select("version", "slot", "shard")
    return versions.where(F.col("version") == version).select("version", "slot", "shard")


def sharded(docs: DataFrame, slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The documents, all columns, with ``shard`` and ``virtual_slot``."""
    slot, shard = fresh(docs, "slot_key", "shard_key")
    known = slot_map.select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    rows = docs.withColumn(slot, slot_of(docs["doc_id"], docs["text"], slots)).join(F.broadcast(known), slot)
    kept = [rows[name] for name in docs.columns if name.lower() not in ("shard", "virtual_slot")]
    return rows.select(*kept, F.col(shard).alias("shard"), F.col(slot).alias("virtual_slot"))


def placed(docs: DataFrame, slot_map: DataFrame, sizes: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, virtual_slot, place): place counts a shard's rows from 0.

    Rows are numbered inside their virtual slot; where a slot begins follows from the row
    counts of the slots before it, so no task sees a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    known = slot_map.join(sizes.select("slot", "n_rows"), "slot").select(
        F.col("slot").alias("virtual_slot"), "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("begin")
    )
    rows = docs.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        slot_of(F.col("doc_id"), F.col("text"), slots).alias("virtual_slot"),
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("number", F.row_number().over(inside).cast("bigint") - 1)
        .join(F.broadcast(known), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "shard", "virtual_slot", (F.col("begin") + F.col("number")).alias("place"))
    )
