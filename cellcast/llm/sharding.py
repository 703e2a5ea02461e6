"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots, thousands of them whatever the input. Bytes
are summed per slot, and a versioned table maps each slot to a shard: the first version
deals the slots out, largest first, each to the shard with the fewest bytes; a later
version edits the map, so that a rebalancing moves whole slots and rehashes no record.
Everything runs as DataFrame expressions. Only tables with one row per slot are ever
brought together in one task.

Law of the assignment: ``bytes``, shards get near equal sizes. A record has at least one
byte, so that empty texts count. A null text has size 1 and the checksum of no bytes.
Equal texts are no unit here, so a text with many copies spreads over the shards. Nor are
equal ids: a record hashes by its id, its size, its checksum and its number among records
equal in all three, so that null ids, one id on many rows and repeated rows spread over the
slots too. Repeated rows get positions of their own and count each; columns beyond
``doc_id`` and ``text`` are not read; an empty table gives an empty result (and a map of
empty slots).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_SLOTS = 4096
N_SHARDS = 8
COPIES = 1000


def virtual_slot(*key: Column | str, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int")


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Id, size, checksum and virtual slot of every row; no text goes further.

    Equal records are counted and listed again by number, ``COPIES`` at a time, so that no task
    lists all of one that is repeated very often.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    key = ["doc_id", "size", "text_crc32"]
    counted = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                           F.crc32(raw).cast("long").alias("text_crc32"))
               .groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("at")
    parts = counted.select(*key, "n", at).repartition("doc_id", "text_crc32", "at")
    last = F.least(F.col("n"), F.col("at") + COPIES) - 1
    each = parts.select(*key, F.explode(F.sequence(F.col("at"), last)).alias("copy"))
    return each.select(*key, virtual_slot(*key, "copy", n_slots=n_slots).alias("vslot"))


def slot_bytes(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Rows and bytes of every slot, empty ones included: ``n_slots`` rows."""
    all_slots = rows.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("vslot"))
    found = rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("bytes"))
    return all_slots.join(found, "vslot", "left").na.fill(0, ["n_rows", "bytes"])


def first_map(slots: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Version 1 of the slot-to-shard map: ``(version, vslot, shard, n_rows, bytes)``.

    One fold over the slots, largest first, keeps the bytes of each shard and gives the
    next slot to the least loaded one.
    """
    ordered = slots.agg(F.sort_array(F.collect_list(F.struct("bytes", "vslot", "n_rows")), asc=False).alias("slots"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("load"),
                     F.array().cast("array<int>").alias("shards"))

    def place(state: Column, slot: Column) -> Column:
        least = F.array_position(state["load"], F.array_min(state["load"])).cast("int")
        load = F.transform(state["load"], lambda x, i: F.when(i + 1 == least, x + slot["bytes"]).otherwise(x))
        return F.struct(load.alias("load"), F.concat(state["shards"], F.array(least - 1)).alias("shards"))

    dealt = ordered.select(F.arrays_zip("slots", F.aggregate("slots", start, place)["shards"].alias("shards")).alias("z"))
    row = F.explode("z").alias("z")
    return dealt.select(row).select(F.lit(1).alias("version"), "z.slots.vslot", F.col("z.shards").alias("shard"),
                                    "z.slots.n_rows", "z.slots.bytes")


def grow_map(current: DataFrame, n_shards: int) -> DataFrame:
    """The next version, with one shard more than ``n_shards``.

    Each shard hands over slots, in the order of their numbers, of at most its share of the
    new shard's bytes. All other slots stay where they are.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("shard")
    moves = F.sum("bytes").over(before) * (n_shards + 1) <= F.sum("bytes").over(whole)
    marked = current.withColumn("moves", moves)
    return marked.select((F.col("version") + 1).alias("version"), "vslot",
                         F.when(F.col("moves"), n_shards).otherwise(F.col("shard")).cast("int").alias("shard"),
                         "n_rows", "bytes")


def store_map(slot_map: DataFrame, folder: str) -> DataFrame:
    """Append a version of the map to the table in ``folder`` and read it back."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)
    return slot_map.sparkSession.read.parquet(folder)


def latest(stored: DataFrame) -> DataFrame:
    return stored.filter(F.col("version") == stored.agg(F.max("version")).scalar())


def place_rows(rows: DataFrame, slot_map: DataFrame, next_map: DataFrame | None = None) -> DataFrame:
    """Shard of every row, and its position in the shard: gapless from 0.

    Positions are numbered within each virtual slot, on top of the rows of the shard's
    slots before it, so no task ever sees a whole shard. ``next_shard`` is the shard under a
    later version of the map, if one is given.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    based = slot_map.select("vslot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("base"))
    later = []
    if next_map is not None:
        based = based.join(next_map.select("vslot", F.col("shard").cast("int").alias("next_shard")), "vslot")
        later = ["next_shard"]
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32"))
    # The map has one row per virtual slot: a fixed number.
    return (rows.withColumn("at", within).join(F.broadcast(based), "vslot")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("base") + F.col("at") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "vslot", *later))
