"""Weighted ranking and calibration metrics over (p, label, weight) rows, optionally per key."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.labels import lookahead_gate
from tallyforge.plans.prefix import exact_quantiles, running_sums
from tallyforge.plans.scratch import materialise


def base_rate_weights(df: DataFrame, *, target: float) -> DataFrame:
    """df with weight so that the weighted share of positives is target; all 1 if one class is empty."""
    r = df.agg(F.avg(F.col("label").cast("double"))).first()[0]  # one number
    if r is None or r in (0.0, 1.0):
        return df.withColumn("weight", F.lit(1.0))
    return df.withColumn("weight", F.when(F.col("label") == 1, target / r).otherwise((1 - target) / (1 - r)))


def _ties(df: DataFrame, keys: list[str]) -> DataFrame:
    pos = F.sum(F.when(F.col("label") == 1, F.col("weight")).otherwise(0.0))
    neg = F.sum(F.when(F.col("label") == 1, 0.0).otherwise(F.col("weight")))
    return df.groupBy(*keys, "p").agg(pos.alias("pos"), neg.alias("neg"))


def _keyed(df: DataFrame, keys: list[str] | None) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("__all", F.lit(0)), ["__all"])


def ranking(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """roc_auc (ties count half; 0.5 with an empty class) and pr_auc (average precision, pooled ties; 0 without positives) per key."""
    df, own = _keyed(df, keys)
    run = running_sums(_ties(df, own), own, "p", ["pos", "neg"])
    totals = run.groupBy(*own).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    met = run.join(totals, own)
    above_pos, above_neg = F.col("all_pos") - F.col("before_pos"), F.col("all_neg") - F.col("before_neg")
    out = met.groupBy(*own).agg(
        F.max("all_pos").alias("all_pos"), F.max("all_neg").alias("all_neg"), F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("wins"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * above_pos / (above_pos + above_neg)).otherwise(0.0)).alias("precise"),
    )
    auc = F.when((F.col("all_pos") > 0) & (F.col("all_neg") > 0), F.col("wins") / (F.col("all_pos") * F.col("all_neg"))).otherwise(0.5)
    ap = F.when(F.col("all_pos") > 0, F.col("precise") / F.col("all_pos")).otherwise(0.0)
    return out.select(*(keys or []), auc.alias("roc_auc"), ap.alias("pr_auc"))


def brier(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg((F.sum(F.col("weight") * F.pow(F.col("p") - F.col("label"), 2)) / F.sum("weight")).alias("brier"))


def reliability(df: DataFrame, *, bins: int = 10) -> DataFrame:
    """One row per bin, empty ones too: n, weight, mean p and observed rate (weighted; 0 if empty)."""
    idx = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins))
    found = df.groupBy(idx.alias("bin")).agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("p")).alias("wp"), F.sum(F.col("weight") * F.col("label")).alias("wy"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    met = every.join(found, "bin", "left").fillna(0)
    share = lambda c: F.when(F.col("w") > 0, F.col(c) / F.col("w")).otherwise(0.0)
    return met.select("bin", "n", "w", share("wp").alias("mean_p"), share("wy").alias("observed"))


def ece(df: DataFrame, *, bins: int = 10) -> DataFrame:
    r = reliability(df, bins=bins)
    return r.agg((F.sum(F.col("w") * F.abs(F.col("mean_p") - F.col("observed"))) / F.sum("w")).alias("ece"))


def operating_point(df: DataFrame, *, cutoff: int) -> DataFrame:
    """Weighted recall, false-positive rate, precision and flagged share when scores below the cutoff are flagged."""
    w, flag, bad = F.col("weight"), F.col("score") < cutoff, F.col("label") == 1
    s = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    sums = df.agg(s(flag & bad).alias("tp"), s(flag & ~bad).alias("fp"), s(bad).alias("pos"), s(~bad).alias("neg"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    return sums.select(div(tp, pos).alias("recall"), div(fp, neg).alias("fpr"), div(tp, tp + fp).alias("precision"), div(tp + fp, pos + neg).alias("flagged"))


def slice_metrics(df: DataFrame) -> DataFrame:
    """Per slice (chain; age below 180 days or not; at most 3 borrows or not): n, positives, roc_auc, pr_auc, with the global weights."""
    slices = F.array(F.concat(F.lit("chain:"), F.col("chain")), F.when(F.col("age") < 180, "age<180d").otherwise("age>=180d"), F.when(F.col("borrows") <= 3, "borrows<=3").otherwise("borrows>3"))
    each = df.withColumn("slice", F.explode(slices))
    counts = each.groupBy("slice").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("positives"))
    return counts.join(ranking(each, ["slice"]), "slice")


def run_backtest(rows: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None, *, target: float | None = 0.0909, cutoff: int = 578, model_version: str = "unknown") -> dict[str, DataFrame]:
    """A whole backtest: the look-ahead gate, scoring, and all metrics, each a small DataFrame.

    rows: as_of_ts, features_valid_at_ts, outcome_start_ts (any of which may be absent), label,
    chain, age, borrows, and what `score` needs to add p and score; without `score` they are
    there. target: the share of positives to weigh for, or none. Raises on an empty table and
    on rows that look ahead. The scored rows are stored once and every metric reads them.
    """
    if {"as_of_ts", "features_valid_at_ts", "outcome_start_ts"} <= set(rows.columns):
        lookahead_gate(rows, mode="raise")
    scored = score(rows) if score else rows
    scored = materialise(scored.select("p", "score", "label", "chain", "age", "borrows"), "backtest")
    count = scored.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("positives"))
    if not count.first()["n_rows"]:
        raise ValueError("a backtest needs at least one row")
    weighted = scored.withColumn("weight", F.lit(1.0)) if target is None else base_rate_weights(scored, target=target)
    head = count.withColumns({"sample_base_rate": F.col("positives") / F.col("n_rows"), "target_base_rate": F.lit(target).cast("double"), "model_version": F.lit(model_version), "score_cutoff": F.lit(cutoff)})
    return {
        "head": head, "ranking": ranking(weighted), "brier": brier(weighted), "reliability": reliability(weighted), "ece": ece(weighted),
        "operating_point": operating_point(weighted, cutoff=cutoff), "slices": slice_metrics(weighted),
    }


def report(found: dict[str, DataFrame]) -> dict:
    """A backtest as one document; every part is a few rows."""
    part = {name: [r.asDict() for r in df.collect()] for name, df in found.items()}
    metrics = part["ranking"][0] | part["brier"][0] | part["ece"][0]
    return part["head"][0] | {
        "metrics": metrics, "reliability": sorted(part["reliability"], key=lambda r: r["bin"]), "operating_point": part["operating_point"][0],
        "slices": {r.pop("slice"): r for r in sorted(part["slices"], key=lambda r: r["slice"])},
    }


def write_report(spark: SparkSession, document: dict, path: str) -> None:
    """Write a report as a JSON file, by Spark, so the path may be on any store it knows."""
    spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def weakest_slice(slices: DataFrame) -> DataFrame:
    return slices.orderBy("pr_auc", "slice").limit(1)


def chain_ranking(slices: DataFrame) -> DataFrame:
    return slices.where(F.startswith("slice", F.lit("chain:"))).orderBy(F.desc("pr_auc"), "slice")


def classification_report(df: DataFrame, *, at: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 at a threshold."""
    hit, bad = F.col("p") >= at, F.col("label") == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    c = df.agg(n(hit & bad).alias("tp"), n(hit & ~bad).alias("fp"), n(~hit & bad).alias("fn"), n(~hit & ~bad).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return c.select("tp", "fp", "fn", "tn", div(tp + tn, tp + fp + fn + tn).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def score_anchors(df: DataFrame) -> DataFrame:
    """p10, p50 and p90 of the predicted probability, and the score deciles: one row."""
    anchors, deciles = exact_quantiles(df, "p", [0.1, 0.5, 0.9]), exact_quantiles(df, "score", [i / 10 for i in range(1, 10)])
    return df.sparkSession.createDataFrame([(*anchors, deciles)], "p10 double, p50 double, p90 double, deciles array<double>")
