"""Readers and writers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of the interchange files.
SCHEMAS = {
    "transfers": "address string, chain string, hash string, ts long, from_addr string, to_addr string, value_wei decimal(38,0), value_eth double",
    "lending_events": "address string, chain string, family string, protocol string, kind string, ts long, block long, amount_wei decimal(38,0)",
    "balances": "address string, chain string, contract string, balance_hex string",
    "snapshots": "address string, chain string, valid_at_ts long, feature_set_version string, features array<double>, completeness double",
    "labels": "address string, chain string, window_start_ts long, window_end_ts long, label int, criteria_version string",
    "holdout": "exportedAt string, featureNames array<string>, rows array<struct<address:string,chain:string,as_of_ts:long,features_valid_at_ts:long,outcome_start_ts:long,features:array<double>,label:int,wallet_age_days:double,total_borrows:double>>",
}


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A table as Parquet, JSON lines or CSV with header, under its declared schema; nothing is inferred."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "json":
        return reader.json(path)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    raise ValueError(f"unknown format {fmt!r}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = "chain", mode: str = "errorifexists") -> None:
    """Write a table, in one folder per value of `by` where it has that column."""
    writer = df.write.mode(mode).format(fmt)
    if by and by in df.columns:
        writer = writer.partitionBy(by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_holdout(rows: DataFrame, path: str, *, feature_names: list[str], exported_at: str) -> None:
    """Write backtest cases (address, chain, as_of_ts, features_valid_at_ts, outcome_start_ts, features, label, wallet_age_days, total_borrows) as the JSON document that holdout_rows() reads.

    The cases go out as JSON lines, in parallel, under the folder `path`, with the feature
    names and the time of export on each line of a header file beside them.
    """
    names = [f.split(":")[0] for f in SCHEMAS["holdout"].split("struct<")[1].rstrip(">").split(",")]
    each = rows.select(F.array(F.struct(*names)).alias("rows"))
    each.select(F.lit(exported_at).alias("exportedAt"), F.array(*(F.lit(n) for n in feature_names)).alias("featureNames"), "rows").write.mode("overwrite").json(path)


def write_features_csv(df: DataFrame, path: str, *, names: list[str], features: str = "features") -> None:
    """Write vectors as CSV with one column per feature, and any other flat columns before them."""
    flat = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))]
    write_table(df.select(*flat, *(F.col(features)[i].alias(n) for i, n in enumerate(names))), path, "csv", by=None, mode="overwrite")


def read_features_csv(spark: SparkSession, path: str, *, names: list[str], others: str = "address string, chain string, label int") -> DataFrame:
    """Vectors of a CSV file that write_features_csv() or the older collector wrote: the other columns and `features`."""
    df = spark.read.schema(f"{others}, " + ", ".join(f"`{n}` double" for n in names)).option("header", True).csv(path)
    return df.select(*(c for c in df.columns if c not in names), F.array(*names).alias("features"))


def holdout_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row per backtest case of a holdout, as one JSON document or as the lines of write_holdout()."""
    lines = spark.read.schema(SCHEMAS["holdout"]).option("multiLine", not path.rstrip("/").endswith(".jsonl")).json(path)
    return lines.selectExpr("inline(rows)")
