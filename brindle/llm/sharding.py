"""Sharding by fixed virtual slots and a versioned slot-to-shard map. DataFrame functions only.

A record's virtual slot is a hash of its id, size and text checksum, so no key or group of
copies with different ids lands in one slot; rows that are equal in all of these are told apart by
where they were read, so that they don't share a slot either. Bytes are summed up per slot; the map gives
each slot, largest first, to the shard with the fewest bytes. Its size is the number of
slots, whatever the number of records. Adding a shard edits the map: slots move only to the
new shard, until it holds its share, and the edited map is stored as the next version.

Null texts have no bytes (size 1, checksum 0). Repeated rows are records of their own;
rows equal in id and text are put in any order among themselves. An empty table gives an
empty map and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.llm.common import pick, store_dir, spill

#: Virtual slots; fixed for the life of a data set.
SLOTS = 4096


def records(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """id, size (UTF-8 bytes plus 1), text_crc32 and vslot of every row."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = pick(docs, id_col, text_col).select(F.col(id_col), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.withColumn("vslot", _slot(slots, id_col, "size", "text_crc32"))


def _slot(slots: int, *of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(slots)).cast("int")


def spread(rows: DataFrame, slots: int) -> DataFrame:
    """Deal rows that are equal in id, size and checksum out to slots of their own; ``rows`` come from a table."""
    id_col = rows.columns[0]
    key = [id_col, "size", "text_crc32"]
    many = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(key)], F.lit(True).alias("_many"))
    same = F.col(id_col).eqNullSafe(F.col("_0")) & (F.col("size") == F.col("_1")) & (F.col("text_crc32") == F.col("_2"))
    placed = rows.withColumn("_at", F.monotonically_increasing_id()).join(many, same, "left")
    own = _slot(slots, *key, "_at")
    return placed.select(*key, F.when(F.col("_many"), own).otherwise(F.col("vslot")).alias("vslot"))


def _weights(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def _lightest(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)).cast("int")


def assign(weights: DataFrame, shards: int) -> DataFrame:
    """vslot, bytes, n and shard: largest slot first, each to the lightest shard.

    The fold runs over one row that holds all slots, of which there are at most ``SLOTS``.
    """
    one = weights.agg(F.sort_array(F.collect_list(F.struct("bytes", "vslot", "n")), False).alias("slots"))
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), shards).alias("loads"), F.expr("cast(array() as array<int>)").alias("to"))

    def put(acc: Column, slot: Column) -> Column:
        k = _lightest(acc["loads"])
        loads = F.transform(acc["loads"], lambda x, i: F.when(i + 1 == k, x + slot["bytes"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(acc["to"], F.array(k - 1)).alias("to"))

    folded = one.select("slots", F.aggregate("slots", start, put, lambda acc: acc["to"]).alias("to"))
    return folded.select(F.explode(F.arrays_zip("slots", "to")).alias("x")).select("x.slots.vslot", "x.slots.bytes", "x.slots.n", F.col("x.to").alias("shard"))


def grow(slot_map: DataFrame) -> DataFrame:
    """The map for one more shard: slots move to the new shard alone.

    Within each old shard, slots are gone through from the smallest; those within the
    share that the shard has to give, 1/(k+1) of its bytes, move.
    """
    k = slot_map.agg((F.max("shard") + 1).alias("k"))
    w = W.partitionBy("shard")
    running = F.sum("bytes").over(w.orderBy("bytes", "vslot").rowsBetween(W.unboundedPreceding, 0))
    rows = slot_map.join(F.broadcast(k))  # one row
    rows = rows.withColumns({"_all": F.sum("bytes").over(w), "_run": running})
    return rows.select("vslot", "bytes", "n", F.when(F.col("_run") * (F.col("k") + 1) <= F.col("_all"), F.col("k")).otherwise(F.col("shard")).cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str, version: int) -> str:
    """Store a map as a version; versions are never overwritten."""
    slot_map.coalesce(1).write.parquet(f"{path}/version={version}")
    return path


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, by default the latest."""
    every = spark.read.parquet(path)
    if version is None:
        latest = every.agg(F.max("version").alias("version"))
        return every.join(F.broadcast(latest), "version")
    return every.where(F.col("version") == version)


def shard(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """id, size, text_crc32, vslot, shard and slot: the row's place in its shard, from 0.

    Places come from the slots' counts before a slot and the order in it, so no task sees
    more than one virtual slot's rows at once.
    """
    spark = docs.sparkSession
    read = spill(records(docs, id_col=id_col, text_col=text_col, slots=slots), "shard-records")
    rows = spill(spread(read, slots), "shard-slots")
    path = save_map(assign(_weights(rows), shards), map_path or store_dir(spark, "slot-map"), 1)
    slot_map = load_map(spark, path)
    before = F.sum("n").over(W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1))
    bases = slot_map.select("vslot", "shard", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("vslot").orderBy(id_col, "text_crc32", "size")) - 1
    out = rows.withColumn("_place", place).join(F.broadcast(bases), "vslot")
    return out.select(id_col, "size", "text_crc32", "vslot", "shard", (F.col("_before") + F.col("_place")).cast("bigint").alias("slot"))
