"""Score drift, score changes, cache state, histories and request summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.plans.prefix import exact_quantiles

KEY = ["address", "chain"]


def bucket_shares(scores: DataFrame, edges: list[float], score: str = "score") -> DataFrame:
    """Share of all scores in each [edge, next) bucket, the last closed; out-of-range scores count in the denominator only."""
    last = len(edges) - 2
    idx = F.lit(None).cast("int")
    for i in range(last, -1, -1):
        inside = (F.col(score) >= edges[i]) & ((F.col(score) <= edges[i + 1]) if i == last else (F.col(score) < edges[i + 1]))
        idx = F.when(inside, i).otherwise(idx)
    total = scores.select(idx.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    every = scores.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bucket"))
    all_n = total.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"))
    met = every.join(F.broadcast(total.where("bucket is not null")), "bucket", "left").crossJoin(F.broadcast(all_n))  # one row
    return met.select("bucket", F.when(F.col("all_n") > 0, F.coalesce("n", F.lit(0)) / F.col("all_n")).otherwise(0.0).alias("share"))


def psi(expected: DataFrame, observed: DataFrame, *, floor: float = 1e-4) -> DataFrame:
    """Population stability index of two share tables and its verdict (0.1 and 0.25)."""
    met = expected.select("bucket", F.greatest("share", F.lit(floor)).alias("e")).join(observed.select("bucket", F.greatest("share", F.lit(floor)).alias("o")), "bucket")
    one = met.agg(F.sum((F.col("o") - F.col("e")) * F.log(F.col("o") / F.col("e"))).alias("psi"))
    return one.withColumn("verdict", F.when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.25, "moderate").otherwise("severe"))


def high_score_convergence(df: DataFrame, *, days: int = 90, least: int = 700) -> DataFrame:
    """The share of all wallets that are at most `days` old and score at least `least`, and how many wallets there are."""
    matches = F.count_if((F.col("age") <= days) & (F.col("score") >= least))
    return df.agg(F.count("*").alias("n"), F.when(F.count("*") > 0, matches / F.count("*")).otherwise(0.0).alias("share"))


def score_changes(history: DataFrame, subscriptions: DataFrame | None = None, *, min_delta: int = 10) -> DataFrame:
    """First scores and changes of at least min_delta, one row per active subscription of the wallet on that chain if these are given.

    subscriptions: subscription_id, address (lower case), chain, revoked_at.
    """
    before = F.lag("score").over(Window.partitionBy(*KEY).orderBy("ts", "event_id"))
    moved = history.withColumn("previous", before).withColumn("delta", F.col("score") - F.col("previous")).where(F.col("previous").isNull() | (F.abs("delta") >= min_delta))
    if subscriptions is None:
        return moved
    active = subscriptions.where("revoked_at is null").select("subscription_id", F.col("address").alias("__of"), F.col("chain").alias("__on"))
    return moved.join(active, (F.lower("address") == F.col("__of")) & (F.col("chain") == F.col("__on"))).drop("__of", "__on")


def cache_state(entries: DataFrame, *, now: int) -> DataFrame:
    """Latest entry per key: fresh to 5 minutes, stale to 60, else miss (its score is the last known good)."""
    last = entries.groupBy(*KEY).agg(F.max(F.struct("ts", "event_id", "score")).alias("x")).select(*KEY, "x.ts", "x.score")
    age = now - F.col("ts")
    return last.withColumn("state", F.when(age <= 300, "fresh").when(age <= 3600, "stale").otherwise("miss"))


def latest_scores(history: DataFrame, *, n: int = 5) -> DataFrame:
    return history.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def score_history(history: DataFrame, *, n: int = 30, newest: bool = False) -> DataFrame:
    """Each wallet's oldest n scores, or its newest."""
    order = Window.partitionBy("address").orderBy(*([F.desc("ts"), F.desc("event_id")] if newest else ["ts", "event_id"]))
    return history.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def request_summary(log: DataFrame, *, wall_seconds: float | None = None) -> DataFrame:
    """One row: exact latency percentiles, maximum, requests per second, requests by status (a map, whatever the statuses are) and by cache use.

    wall_seconds: the wall clock of the run; without it the time from the first to the last request. cached: true, false, or null where unknown.
    """
    p50, p95, p99 = exact_quantiles(log, "latency_ms", [0.5, 0.95, 0.99])
    span = F.lit(float(wall_seconds)) if wall_seconds is not None else F.greatest(F.max("ts") - F.min("ts"), F.lit(1)).cast("double")
    n = F.count("*")
    one = log.agg(n.alias("n"), F.max("latency_ms").alias("max_ms"), F.when(span > 0, n / span).otherwise(0.0).alias("per_second"), F.count_if(F.col("cached")).alias("n_cached"), F.count_if(~F.col("cached")).alias("n_uncached"), F.count_if(F.col("cached").isNull()).alias("n_unknown"))
    by = log.groupBy("status").agg(n.alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"))  # one entry a status
    fixed = {k: F.lit(v).cast("double") for k, v in (("p50_ms", p50), ("p95_ms", p95), ("p99_ms", p99))}
    return one.crossJoin(F.broadcast(by)).withColumns(fixed)  # one row each
