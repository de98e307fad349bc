"""Sharding by fixed virtual slots with a versioned slot-to-shard map.

Every record is hashed into one of VIRTUAL_SLOTS slots; a record's slot never changes.
Bytes are added up per slot, and a small map says which shard owns each slot. The map is
a table of at most VIRTUAL_SLOTS rows, stored under a version number; rebalancing edits
the map, never the hashing, so only the records of moved slots move. All of it is
DataFrame expressions.

Edge cases: a null text has no bytes (size 1, crc32 0). A null id hashes like the empty
string. Repeated rows and repeated ids share a slot. An empty table gives an empty map of
equal weights and no rows. Columns of other names are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table
from tallyforge.plans.scratch import materialise, scratch_path
from tallyforge.plans.skew import explode_copies, rank_within

VIRTUAL_SLOTS = 4096


def virtual_slot(key: Column, slots: int = VIRTUAL_SLOTS) -> Column:
    """The slot of a key: the first 32 bits of the MD5 of its text form, modulo the slot count."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def weigh(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """One row per record: id, size (UTF-8 bytes + 1), text_crc32, virtual_slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), virtual_slot(F.col(id_col), slots).alias("virtual_slot"),
    )


def slot_bytes(weighed: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """(virtual_slot, bytes) for every slot; slots without records have 0."""
    every = weighed.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    sums = weighed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    return every.join(F.broadcast(sums), "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def balance(weights: DataFrame, shards: int) -> DataFrame:
    """(virtual_slot, bytes, shard): heaviest slot first, each to the lightest shard so far.

    weights has at most VIRTUAL_SLOTS rows, so one array holds them. Ties go to the lower
    shard and the lower slot.
    """
    heaviest = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "virtual_slot")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("owner"))

    def give(done: Column, slot: Column) -> Column:
        to = (F.array_position(done["load"], F.array_min(done["load"])) - 1).cast("int")
        load = F.transform(done["load"], lambda x, i: F.when(i == to, x - slot["neg"]).otherwise(x))
        return F.struct(load.alias("load"), F.concat(done["owner"], F.array(to)).alias("owner"))

    one = weights.agg(heaviest.alias("slots"))
    dealt = one.select("slots", F.aggregate("slots", start, give)["owner"].alias("owner"))
    return dealt.select(F.explode(F.arrays_zip("slots", "owner")).alias("x")).select(
        F.col("x.slots.virtual_slot"), (-F.col("x.slots.neg")).alias("bytes"), F.col("x.owner").alias("shard")
    )


def grow(current: DataFrame, shards: int) -> DataFrame:
    """The map edited for one more shard (number `shards`): slots move only into the new one.

    Each old shard gives up its smallest slots while what it has given stays within
    1 / (shards + 1) of its bytes. current: (virtual_slot, bytes, shard), at most VIRTUAL_SLOTS rows.
    """
    from pyspark.sql import Window

    own = Window.partitionBy("shard").orderBy("bytes", "virtual_slot")
    given, whole = F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, 0)), F.sum("bytes").over(Window.partitionBy("shard"))
    return current.select("virtual_slot", "bytes", F.when(given * (shards + 1) <= whole, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


class SlotMaps:
    """Versioned slot-to-shard maps in one folder: version=N holds the map as it was published."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def publish(self, slot_map: DataFrame, version: int) -> DataFrame:
        """Store a map under a new version; an existing version is never overwritten."""
        where = f"{self.path}/version={version}"
        slot_map.coalesce(1).write.mode("errorifexists").parquet(where)
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}")


def assign(docs: DataFrame, slot_map: DataFrame, id_col: str = "doc_id", out: str = "shard") -> DataFrame:
    """docs with the shard of each record, by a broadcast of the map (at most VIRTUAL_SLOTS rows); no shuffle."""
    owner = slot_map.select(F.col("virtual_slot").alias("__slot"), F.col("shard").alias("__owner"))
    return docs.withColumn("__vs", virtual_slot(F.col(id_col))).join(F.broadcast(owner), F.col("__vs") == F.col("__slot")).withColumn(out, F.col("__owner")).drop("__vs", "__slot", "__owner")


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the records, extra columns included, in one folder per shard."""
    assign(docs, slot_map, id_col, "shard").write.partitionBy("shard").parquet(path)


def op1_slot_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """All documents in shards 0 to 7 under the law `bytes`; slot is a record's place in its shard.

    Two passes over slim rows: byte sums per virtual slot, then places. Places are counted
    within hash buckets of a shard, so no task holds a shard. Equal (id, size, crc) rows
    travel as one row with a count.
    """
    weighed = weigh(table(spark, sf_dir, "documents"))
    slim = materialise(weighed.groupBy(*weighed.columns).agg(F.count("*").alias("copies")), "weighed")
    sums = slot_bytes(slim.withColumn("size", F.col("size") * F.col("copies")))
    slot_map = SlotMaps(spark, scratch_path(spark, "slot-map")).publish(balance(sums, shards), 1)
    placed = rank_within(assign(slim, slot_map), "shard", ["doc_id", "text_crc32", "size"], "first", copies="copies")
    each = explode_copies(placed, "copies", "copy")
    return each.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("copy")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
