"""The register of entities: clusters kept up to date by new links and reversals, with the log that explains them.

Stored are the links (those cut by a reversal marked as such, so that they never merge
again), the members of each entity, by address and by entity, an append-only audit of every
merge and reversal with the signals that led to it, and an append-only log of who joined and left.

A batch touches the entities at the ends of its links. Only their members' links are read and
clustered again; everybody else stays. An entity is named by its smallest address. What a
batch changes is worked out and written down first and then applied store by store, each of
which takes a batch once: a job that is lost at any point is run again with the same batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.graph import connected_components
from tallyforge.plans.scratch import materialise
from tallyforge.sources.store import Store


class EntityRegister:
    """The register at a path; one writer at a time, whose batches have rising numbers."""

    def __init__(self, spark: SparkSession, path: str, *, partitions: int = 64) -> None:
        own = lambda name, ddl, keys, within: Store(spark, f"{path}/{name}", ddl, keys, partitions=partitions, within=within)
        self.spark, self.path = spark, path
        self.links = own("links", "a string, b string, confidence double, signals array<string>, reversed boolean", ["a", "b"], ["a"])
        self.members = own("members", "address string, entity_id string, since long", ["address"], ["address"])
        self.groups = own("groups", "entity_id string, address string", ["entity_id", "address"], ["entity_id"])
        self.audit = own("audit", "entity_id string, action string, address_a string, address_b string, confidence double, signals array<string>, at long", ["entity_id"], ["address_a"])
        self.log = own("log", "entity_id string, address string, action string, at long, seq long", ["address"], ["address"])

    def take(self, merges: DataFrame, reversals: DataFrame, *, at: int, batch: int) -> None:
        """Merge links (a, b, confidence, signals) and reversals (a, b) of one time. A reversal of the same batch wins over its link; one of an unknown link does nothing."""
        plan = f"{self.path}/plan/batch={batch}"
        changes, links, audit = (f"{plan}/{n}" for n in ("changes", "links", "audit"))
        fs, done = self.links._fs(f"{audit}/_SUCCESS")
        if not fs.exists(done):
            self._plan(merges, reversals, at, changes, links, audit)
        read = self.spark.read.parquet
        name = ("register", batch)
        self.links.upsert(read(links), batch=name)
        moved = read(changes)
        self.members.merge(moved.select("address", F.col("new").alias("entity_id"), F.lit(at).cast("long").alias("since")), lambda both: _last(both, "address").where("entity_id is not null"), batch=name)
        left = moved.where("old is not null").select(F.col("old").alias("entity_id"), "address", F.lit(True).alias("gone"))
        came = moved.where("new is not null").select(F.col("new").alias("entity_id"), "address", F.lit(False).alias("gone"))
        self.groups.merge(left.unionByName(came), lambda both: _last(both, "entity_id", "address").where("not coalesce(gone, false)"), batch=name)
        self.audit.append(read(audit), batch=name)
        told = lambda df, action, seq: df.select("entity_id", "address", F.lit(action).alias("action"), F.lit(at).cast("long").alias("at"), F.lit(2 * batch + seq).cast("long").alias("seq"))
        self.log.append(told(left, "removed", 0).unionByName(told(came, "joined", 1)), batch=name)

    def _plan(self, merges: DataFrame, reversals: DataFrame, at: int, changes: str, links: str, audit: str) -> None:
        """Work out what a batch changes, and write it down; the audit last."""
        ends = lambda df: df.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *(c for c in df.columns if c not in ("a", "b")))
        given = ends(merges).groupBy("a", "b").agg(F.max_by(F.struct("confidence", "signals"), "confidence").alias("x")).select("a", "b", "x.*")
        undone = ends(reversals.select("a", "b")).distinct().withColumn("undone", F.lit(True))
        named = materialise(given.join(undone, ["a", "b"], "full"), "named")
        known = self.links.read(parts=self.links.parts_of(named)).select("a", "b", F.col("confidence").alias("k_confidence"), F.col("signals").alias("k_signals"), "reversed")
        met = named.join(known, ["a", "b"], "left").where("not coalesce(reversed, false) and (confidence is not null or reversed is not null)")
        now = materialise(met.select(
            "a", "b", F.coalesce("confidence", "k_confidence").alias("confidence"), F.coalesce("signals", "k_signals").alias("signals"), F.coalesce("undone", F.lit(False)).alias("reversed"), F.col("reversed").isNull().alias("first"),
        ), "now")
        now.select("a", "b", "confidence", "signals", "reversed").write.mode("overwrite").parquet(links)
        touched = now.select(F.explode(F.array("a", "b")).alias("address")).distinct()
        own = materialise(self.members.read(parts=self.members.parts_of(touched)).join(touched, "address", "left_semi"), "own")
        entities = own.select("entity_id").distinct()
        rest = self.groups.read(parts=self.groups.parts_of(entities)).join(entities, "entity_id", "left_semi")
        around = materialise(rest.select("address", F.col("entity_id").alias("old")).unionByName(touched.join(own, "address", "left_anti").select("address", F.lit(None).cast("string").alias("old"))), "around")
        starts = around.select(F.col("address").alias("a"))
        held = self.links.read(parts=self.links.parts_of(starts)).where("not reversed").join(starts, "a", "left_semi").select("a", "b")
        # a link of this batch takes the place of what was known of it
        in_force = materialise(held.join(now.select("a", "b"), ["a", "b"], "left_anti").unionByName(now.where("not reversed").select("a", "b")), "in-force")
        labels = materialise(connected_components(in_force), "labels").select(F.col("node").alias("address"), F.col("component").alias("new"))
        moved = materialise(around.join(labels, "address", "left"), "moved")
        moved.where("not (old <=> new)").select("address", "old", "new").write.mode("overwrite").parquet(changes)
        side = lambda c: moved.select(F.col("address").alias("address_a"), F.col(c).alias("entity_id"))
        row = lambda df, action: df.select("entity_id", F.lit(action).alias("action"), "address_a", F.col("b").alias("address_b"), "confidence", "signals", F.lit(at).cast("long").alias("at"))
        ours = now.withColumnRenamed("a", "address_a")
        merged = row(ours.where("first and not reversed").join(side("new"), "address_a"), "merge")
        # a link that came and was cut in one batch has been in no entity: its audit bears the smaller address
        cut = row(ours.where("reversed").join(side("old"), "address_a").withColumn("entity_id", F.coalesce("entity_id", "address_a")), "reverse")
        merged.unionByName(cut).write.mode("overwrite").parquet(audit)

    def entities(self) -> DataFrame:
        """(entity_id, member_count, cohesion): the entities in force; cohesion is the weakest of their links."""
        sizes = self.groups.read().groupBy("entity_id").agg(F.count("*").alias("member_count"))
        tight = self.links.read().where("not reversed").join(self.members.read().select(F.col("address").alias("a"), "entity_id"), "a").groupBy("entity_id").agg(F.min("confidence").alias("cohesion"))
        return sizes.join(tight, "entity_id")


def _last(both: DataFrame, *keys: str) -> DataFrame:
    """Of the rows of each key the newest."""
    rest = [c for c in both.columns if c not in (*keys, "new")]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "new").alias("x")).select(*keys, "x.*")
