"""Exact deduplication against a persistent digest index.

The index is a folder: a log of runs, each bucketed and sorted by digest, and a small table
of what was added (generation, buckets, rows). It is found again by its path, in any session.
A run holds (digest, keep_id, group_size, run): the id that stays of a digest that was new, or null
and the number of further rows of a digest that the index knew. A delivery of documents is
reduced to one row per digest (map-side combine: a text with many copies costs one row a
task); the sort-merge anti-join with the index finds what is new, and both parts are appended
as another run. The number of buckets follows from the first delivery's size, so that the
index is never shuffled and a bucket stays small; after RUNS runs the log is compacted.

What was delivered first stays. So that of equal texts the largest doc_id stays, the query and
the pipeline hand over the documents in two deliveries, upper half of the ids first.

Edge cases: a null text counts as the empty text. A null id is smaller than every other
id. Rows with equal id and equal text are copies of one another: one of them stays. An
empty table gives an empty result and adds nothing. Other columns are carried along.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table
from tallyforge.plans.rows import drop_rows
from tallyforge.plans.scratch import materialise, scratch_path
from tallyforge.plans.skew import ascii_lower, explode_copies, lookup

#: Digests a bucket of a new index is laid out for, with as much again to come, and the least and most buckets.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 500_000, 16, 65_536
#: Runs after which the index is rewritten as one.
RUNS = 32


def normalised(text: Column) -> Column:
    """A-Z in lower case; null as the empty text."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def digest_of(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text).cast("binary"), 256)


class DigestIndex:
    """The log of (digest, keep_id, group_size, run) under a path, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def scratch(cls, spark: SparkSession) -> DigestIndex:
        return cls(spark, scratch_path(spark, "digest-index"))

    def _added(self) -> list:
        """One row a run: generation, buckets, rows; none if there is no index."""
        try:
            return self.spark.read.schema("generation int, buckets int, rows long, kind string").parquet(f"{self.path}/added").collect()  # one row a delivery since the log was begun
        except AnalysisException:
            return []

    def _table(self, generation: int, buckets: int, kind: str) -> str:
        """The generation's table, told to this session if it does not know it."""
        name = f"digest_index_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}_{generation}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id {kind}, group_size BIGINT, run INT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/g{generation}'")
        self.spark.catalog.refreshTable(name)
        return name

    def log(self) -> DataFrame | None:
        """All runs of the latest generation."""
        last = max(self._added(), key=lambda r: r["generation"], default=None)
        return last and self.spark.table(self._table(last["generation"], last["buckets"], last["kind"]))

    def read(self) -> DataFrame:
        """(digest, keep_id, group_size, run that brought it), one row per digest; the buckets spare the shuffle."""
        return self.log().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.min("run").alias("run"))

    def runs(self) -> int:
        return len(self._added())

    def parted(self, groups: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(digest groups that the index does not hold, those that it does), by sort-merge joins with its buckets."""
        log = self.log()
        if log is None:
            return groups, None
        known, same = log.select(F.col("digest").alias("__known")).hint("merge"), F.col("digest") == F.col("__known")
        return groups.join(known, same, "left_anti"), groups.join(known, same, "left_semi")

    def append(self, groups: DataFrame) -> None:
        """Add a delivery's stored digest groups as one more run: new digests with their keep_id, known ones with their count."""
        new, known = self.parted(groups)
        run = new if known is None else new.unionByName(known.withColumn("keep_id", F.lit(None).cast(groups.schema["keep_id"].dataType)))
        rows, before = groups.count(), self._added()
        run = run.withColumn("run", F.lit(len(before)))
        if before:
            generation, buckets = max((r["generation"], r["buckets"]) for r in before)
        else:
            generation, buckets = 0, LEAST_BUCKETS
            while buckets < min(MOST_BUCKETS, 2 * rows / BUCKET_ROWS):
                buckets *= 2
        if rows or not before:
            self._write(run, generation, buckets, rows)
        if sum(r["generation"] == generation for r in before) >= RUNS:
            self._write(self.read(), generation + 1, buckets, sum(r["rows"] for r in before) + rows)

    def _write(self, run: DataFrame, generation: int, buckets: int, rows: int) -> None:
        kind = run.schema["keep_id"].dataType.simpleString()
        run.select("digest", "keep_id", "group_size", "run").repartition(buckets, "digest").write.insertInto(self._table(generation, buckets, kind))
        self.spark.range(1, numPartitions=1).selectExpr(f"{generation} AS generation", f"{buckets} AS buckets", f"{rows}L AS rows", f"'{kind}' AS kind").write.mode("append").parquet(f"{self.path}/added")


def digest_groups(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of rows (digest, doc_id, copies); the largest doc_id stays."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, copies): the rows of each id and text, stored."""
    slim = docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest"))
    return materialise(slim.groupBy("doc_id", "digest").agg(F.count("*").alias("copies")), "digests")


def deliveries(rows: DataFrame) -> list[DataFrame]:
    """Digest rows in two deliveries of about equal size, larger ids first and null ids last."""
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0] if rows.schema["doc_id"].dataType.simpleString() in ("int", "bigint", "double") else rows.agg(F.min("doc_id")).first()[0]
    upper = F.coalesce(F.col("doc_id") >= F.lit(middle), F.lit(False))
    return [rows.where(upper), rows.where(~upper)]


def decide(parts: list[DataFrame], index: DigestIndex) -> DataFrame:
    """doc_id, digest, copies, keep_id, group_size, fresh of every row of the deliveries, which the index holds then.

    keep_id is the id that stays of all that was delivered so far, and group_size counts all of
    it; fresh: the index did not hold the digest before.
    """
    rows, before = None, index.runs()
    for part in parts:
        index.append(materialise(digest_groups(part), "groups"))
        rows = part if rows is None else rows.unionByName(part)
    total = rows.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    groups = materialise(index.read().select("digest", "keep_id", "group_size", (F.col("run") >= before).alias("fresh")), "index")
    return lookup(rows, groups, ["digest"], "group_size", max(total, 1))


def op4_digest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    decided = decide(deliveries(digest_rows(table(spark, sf_dir, "documents"))), DigestIndex.scratch(spark))
    each = explode_copies(decided, "copies", "copy")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def stay(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one per text that the index did not hold before."""
    decided = decide(deliveries(digest_rows(docs, id_col, text_col)), index)
    kept = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    marked = materialise(decided.select(F.col("doc_id").alias("id"), F.col("digest").alias("mark"), kept.alias("kept"), "copies"), "decided")
    return drop_rows(docs, id_col, digest_of(F.col(text_col)), marked.where("not kept"), marked.where("kept and copies > 1"))


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), h AS (SELECT doc_id, sha256(t) AS text_sha256, t FROM d)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, text_sha256
FROM h
"""
