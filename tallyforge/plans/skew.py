"""Lookups and numberings that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group is hot when it has more than 1 / HOT_PARTS of all rows, so at most HOT_PARTS - 1 groups are.
HOT_PARTS = 2048


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, parts: int = HOT_PARTS) -> DataFrame:
    """rows left-joined to groups (one row a key, with the key's row count in column size).

    Groups with more than total / parts rows are broadcast: fewer than `parts` of them can
    exist, whatever the data. All other keys go through a shuffle join in which no key
    holds more than total / parts rows. Null keys match nothing.
    """
    taken = {c.lower() for c in rows.columns}
    values = [c for c in groups.columns if c not in keys]
    clash = [c for c in values if c.lower() in taken]
    if clash:
        raise ValueError(f"columns in both tables: {clash}")
    limit = max(1, total // parts)
    hot = groups.where(F.col(size) > limit)
    cold = groups.where(F.col(size) <= limit)
    hot = hot.select(*(F.col(k).alias(f"__h_{k}") for k in keys), *(F.col(v).alias(f"__h_{v}") for v in values))
    cold = cold.select(*(F.col(k).alias(f"__c_{k}") for k in keys), *(F.col(v).alias(f"__c_{v}") for v in values), F.lit(False).alias("__c_hot"))
    on_hot = [F.col(k) == F.col(f"__h_{k}") for k in keys]
    found = rows.join(F.broadcast(hot), on_hot, "left").withColumn("__hot", F.col(f"__h_{size}").isNotNull())
    spread = F.xxhash64(*(F.col(c) for c in rows.columns))
    for k in keys:
        kind = groups.schema[k].dataType
        found = found.withColumn(f"__k_{k}", F.when(F.col("__hot"), spread.cast("string").cast(kind)).otherwise(F.col(k)))
    on_cold = [F.col(f"__k_{k}") == F.col(f"__c_{k}") for k in keys] + [F.col("__hot") == F.col("__c_hot")]
    joined = found.join(cold, on_cold, "left")
    return joined.select(*(F.col(c) for c in rows.columns), *(F.coalesce(f"__h_{v}", f"__c_{v}").alias(v) for v in values))


def rank_within(df: DataFrame, group: str, order: list[str], out: str, copies: str | None = None, spread: int | Column = 512) -> DataFrame:
    """Number the rows of each group from 0 without gaps, without gathering a group in one task.

    Rows of a group are dealt to `spread` buckets by a hash of `order`; each bucket is
    numbered on its own and starts where the buckets before it end. The table of bucket
    counts has at most groups x spread rows, so `group` must have a bounded number of
    values; spread may be a column, the buckets of the row's group. copies: a column with the number of equal rows that a row stands for; the
    number is then that of its first copy.
    """
    n = F.col(copies) if copies else F.lit(1)
    dealt = df.withColumn("__b", F.pmod(F.xxhash64(*(F.col(c) for c in order)), spread if isinstance(spread, Column) else F.lit(spread)).cast("int"))
    counts = dealt.groupBy(group, "__b").agg(F.sum(n).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(group).alias("__g"), F.col("__b").alias("__sb"), F.coalesce(before, F.lit(0)).alias("__start"))
    own = Window.partitionBy(group, "__b").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    if copies:
        place = F.sum(n).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - n
    else:
        place = F.row_number().over(own) - 1
    placed = dealt.withColumn("__place", place)
    joined = placed.join(F.broadcast(starts), placed[group].eqNullSafe(F.col("__g")) & (placed["__b"] == F.col("__sb")), "left")
    return joined.withColumn(out, (F.col("__start") + F.col("__place")).cast("long")).drop("__b", "__g", "__sb", "__start", "__place")


def explode_copies(df: DataFrame, copies: str, out: str) -> DataFrame:
    """One row for each of the copies, numbered from 0 in column out."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1))).drop(copies)


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
