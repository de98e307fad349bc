"""Running sums over a sorted table that no single task ever holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.plans.scratch import materialise


def running_sums(df: DataFrame, keys: list[str], order: str | list[str], values: list[str], *, partitions: int | None = None) -> DataFrame:
    """df with before_<v> for each v: the sum of v over the rows of the same keys with a smaller `order`.

    (keys, order) must be unique; null keys are a key of their own and null orders come first.
    Rows are dealt to range partitions and summed within each; what the partitions of a key
    before it hold is added from a table of at most keys x partitions rows. The dealt rows are
    stored once, so both passes see the same partitions.
    """
    order = [order] if isinstance(order, str) else order
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()), "running")
    totals = dealt.groupBy(*keys, "__part").agg(*(F.sum(v).alias(f"__t_{v}") for v in values))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__part", *(F.coalesce(F.sum(f"__t_{v}").over(earlier), F.lit(0)).alias(f"__o_{v}") for v in values))
    own = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.select("*", *(F.coalesce(F.sum(v).over(own), F.lit(0)).alias(f"__w_{v}") for v in values))
    offsets = offsets.withColumnsRenamed({k: f"__k_{k}" for k in keys} | {"__part": "__at"})
    same = (F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys)
    met = summed.join(offsets, reduce(lambda a, b: a & b, same, F.col("__part") == F.col("__at")))
    return met.select(*df.columns, *((F.col(f"__w_{v}") + F.col(f"__o_{v}")).alias(f"before_{v}") for v in values))


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, *, partitions: int | None = None) -> DataFrame:
    """df with `out`: the last value that is not null among the rows of the same keys up to each row, in order.

    Rows are dealt to range partitions and carried within each. Only a key that reaches over the end of
    a partition has earlier rows elsewhere, and there are fewer of those than partitions: what is
    carried over is a table of at most two rows a partition. Null keys are a key of their own.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(n, *keys, *order).withColumn("__cf_part", F.spark_partition_id()), "carried")
    same = lambda names: reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{names}{k}")) for k in keys))
    wide = dealt.groupBy(*keys).agg(F.min("__cf_part").alias("__cf_lo"), F.max("__cf_part").alias("__cf_hi")).where("__cf_lo < __cf_hi")
    wide = F.broadcast(wide.select(*(F.col(k).alias(f"__cfw_{k}") for k in keys)))  # fewer than n rows
    last = dealt.where(F.col(value).isNotNull()).join(wide, same("__cfw_"), "left_semi").groupBy(*keys, "__cf_part").agg(F.max_by(value, F.struct(*order)).alias("__cf_last"))
    parts = dealt.join(wide, same("__cfw_"), "left_semi").select(*keys, "__cf_part").distinct().withColumn("__cf_last", F.lit(None).cast(df.schema[value].dataType))
    ends = last.unionByName(parts).groupBy(*keys, "__cf_part").agg(F.first("__cf_last", ignorenulls=True).alias("__cf_last"))
    earlier = Window.partitionBy(*keys).orderBy("__cf_part").rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.select(*(F.col(k).alias(f"__cfb_{k}") for k in keys), F.col("__cf_part").alias("__cf_at"), F.last("__cf_last", ignorenulls=True).over(earlier).alias("__cf_brought"))
    own = Window.partitionBy(*keys, "__cf_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = dealt.withColumn("__cf_own", F.last(value, ignorenulls=True).over(own))
    met = held.join(F.broadcast(brought), same("__cfb_") & (F.col("__cf_part") == F.col("__cf_at")), "left")  # at most 2 n rows
    return met.select(*df.columns, F.coalesce("__cf_own", "__cf_brought").alias(out))


def exact_quantiles(df: DataFrame, column: str, qs: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation, as exact as a full sort, without one task holding all values.

    Equal values are counted first; the running sums of the counts say which values stand at
    the two ranks around each quantile. At most two rows a quantile reach the driver.
    """
    ticks = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    placed = materialise(running_sums(ticks, ["all"], "v", ["n"]), "ranks")
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return [None] * len(qs)
    ranks = [q * (total - 1) for q in qs]
    wanted = sorted({int(x) for r in ranks for x in (r // 1, -(-r // 1))})
    last = F.col("before_n") + F.col("n")
    hit = placed.where(F.exists(F.array(*(F.lit(w) for w in wanted)), lambda w: (w >= F.col("before_n")) & (w < last))).select("v", "before_n", last.alias("last")).collect()
    at = {w: next(r["v"] for r in hit if r["before_n"] <= w < r["last"]) for w in wanted}
    return [at[int(r // 1)] * (1 - r % 1) + at[int(-(-r // 1))] * (r % 1) for r in ranks]
