"""Outcome labels, the point-in-time store, and dataset building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.plans.prefix import carry_forward, exact_quantiles
from tallyforge.sources.store import Store, Version

KEY = ["address", "chain"]
SNAPSHOT_KEY = ["address", "chain", "valid_at_ts", "feature_set_version"]


def window_labels(events: DataFrame, *, cutoff: int, end: int, closed: bool = True) -> DataFrame:
    """Wallets that borrowed before the cutoff: 1 if liquidated on that chain in the window, else 0."""
    in_window = (F.col("ts") >= cutoff) & ((F.col("ts") <= end) if closed else (F.col("ts") < end))
    seen = events.groupBy(*KEY).agg(F.max((F.col("kind") == "borrow") & (F.col("ts") < cutoff)).alias("borrowed"), F.max(((F.col("kind") == "liquidation") & in_window).cast("int")).alias("label"))
    return seen.where("borrowed").select(*KEY, F.lit(cutoff).cast("long").alias("window_start_ts"), F.lit(end).cast("long").alias("window_end_ts"), "label")


def repay_labels(df: DataFrame) -> DataFrame:
    """1 = good payer, 0 = bad, -1 = excluded; from borrows, repays, liquidations."""
    b, r = F.col("borrows"), F.col("repays")
    return df.withColumn("label", F.when(b == 0, -1).when(F.col("liquidations") > 0, 0).when(r >= 0.9 * b, 1).when(r < 0.5 * b, 0).otherwise(-1))


def balanced_sample(stats: DataFrame, *, n: int) -> DataFrame:
    """n liquidated wallets (1) and n clean repayers (0), each the first by hash of the address."""
    classed = stats.withColumn("label", F.when(F.col("liquidations") > 0, 1).when(F.col("repays") > 0, 0)).where("label is not null")
    ordered = [classed.where(F.col("label") == k).orderBy(F.md5(F.col("address").cast("binary")), "address").limit(n) for k in (0, 1)]
    return ordered[0].unionByName(ordered[1])


def put_snapshots(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The store with the batch upserted on the natural key; the later row of a batch (by `seq`) wins."""
    both = store.withColumn("__new", F.lit(-1).cast("long")).unionByName(batch.withColumnRenamed("seq", "__new"))
    last = Window.partitionBy(*SNAPSHOT_KEY).orderBy(F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn", "__new")


def feature_store(spark: SparkSession, path: str, *, partitions: int = 64) -> Store:
    """The stored point-in-time features: one row a (address, chain, valid_at_ts, feature_set_version), a wallet's rows in one partition."""
    return Store(spark, path, "address string, chain string, valid_at_ts long, feature_set_version string, features array<double>, completeness double", SNAPSHOT_KEY, partitions=partitions, within=KEY)


def put(store: Store, snapshots: DataFrame, *, batch: tuple[str, int] | None = None) -> Version:
    """Upsert snapshots (with `seq`, the later of two with one key wins); only the partitions they fall in are rewritten."""
    return store.upsert(snapshots, order="seq", batch=batch)


def stored_as_of(store: Store, requests: DataFrame, *, version: str, at: Version | int | None = None) -> DataFrame:
    """as_of_join() against the store, reading the partitions of the requests' wallets alone. at: the store's version, for a repeatable read."""
    return as_of_join(requests, store.read(at, store.parts_of(requests)), version=version)


def as_of_join(requests: DataFrame, snapshots: DataFrame, *, version: str) -> DataFrame:
    """Each request (request_id, address, chain, as_of_ts) with the latest snapshot at or before it, or nulls.

    Requests and snapshots are dealt together by (wallet, time) to range partitions, the last
    snapshot seen is carried forward within each, and from one to the next where a wallet reaches
    over several: no pairing of requests with earlier snapshots, and no wallet in one task.
    """
    data = [c for c in snapshots.columns if c not in (*KEY, "feature_set_version")]
    snap = snapshots.where(F.col("feature_set_version") == version).select(*KEY, F.col("valid_at_ts").alias("__at"), F.lit(0).alias("__side"), F.struct(*data).alias("__snap"))
    ask = requests.select(*KEY, F.col("as_of_ts").alias("__at"), F.lit(1).alias("__side"), F.struct(*(c for c in requests.columns if c not in KEY)).alias("__ask"))
    both = snap.unionByName(ask, allowMissingColumns=True)
    carried = carry_forward(both, KEY, ["__at", "__side"], "__snap", "__last").where("__side = 1")
    return carried.select(*KEY, "__ask.*", "__last.*")


def lookahead_gate(rows: DataFrame, *, mode: str = "split") -> DataFrame:
    """split: df with `violation` (null if none); raise: df, or an error if any row looks ahead."""
    late = F.when(F.col("features_valid_at_ts") > F.col("as_of_ts"), "features after as-of").when(F.col("outcome_start_ts") < F.col("as_of_ts"), "outcome before as-of")
    if mode == "split":
        return rows.withColumn("violation", late)
    n = rows.where(late.isNotNull()).count()
    if n:
        raise ValueError(f"{n} rows look ahead")
    return rows


def temporal_holdout(dataset: DataFrame, targets: DataFrame, *, start: int, cutoff: int) -> DataFrame:
    """Dataset rows in [start, cutoff) of wallets that are in the dataset on one chain only, with their targets."""
    shared = dataset.groupBy("address").agg(F.count("*").alias("n")).where("n > 1").select("address")
    return dataset.where((F.col("split_ts") >= start) & (F.col("split_ts") < cutoff)).join(shared, "address", "left_anti").join(targets, KEY)


def temporal_split(df: DataFrame, *, at: int, ts: str = "split_ts") -> DataFrame:
    return df.withColumn("split", F.when(F.col(ts) < at, "train").otherwise("test"))


def stratified_split(df: DataFrame, *, share: float = 0.2, seed: int = 42, label: str = "label", key: str = "id") -> DataFrame:
    """df with split: rows whose seeded hash falls below `share` are test; each class gets the share in expectation, without a sort."""
    bucket = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(label).cast("string"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 10000
    return df.withColumn("split", F.when(bucket < int(share * 10000), "test").otherwise("train"))


def clip_quantile(df: DataFrame, cols: list[str], *, q: float = 0.99) -> DataFrame:
    """Values above each column's q-quantile (linear interpolation) become it."""
    caps = {c: exact_quantiles(df, c, [q])[0] for c in cols}
    return df.withColumns({c: F.when(F.col(c) > caps[c], F.lit(caps[c])).otherwise(F.col(c)) for c in cols if caps[c] is not None})


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """df without the rows in which one of cols is null or not a number."""
    kinds = dict(df.dtypes)
    for c in cols:
        df = df.where(F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("float", "double") else F.lit(True)))
    return df


def dataset_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.sum((F.col("label") == 1).cast("long")).alias("good"), F.sum((F.col("label") == 0).cast("long")).alias("bad"), F.sum((F.col("label") == -1).cast("long")).alias("excluded"))


def standard_scale_params(df: DataFrame, features: str = "features", n: int = 34) -> DataFrame:
    """(feature, mean, scale): population deviation, in one pass over the rows."""
    one = df.agg(*(f(F.col(features)[i]).alias(f"{k}{i}") for i in range(n) for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("scale")) for i in range(n)))))
