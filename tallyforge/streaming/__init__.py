"""Structured Streaming jobs: metering, activity, score changes, bursts and rescoring.

A stream is any streaming DataFrame with the columns a job names; `at` is its event time.
Every job is a transformation of the stream; run_available() drains one into a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tallyforge.plans.scratch import scratch_path


def run_available(stream: DataFrame, name: str, *, mode: str = "append") -> DataFrame:
    """Process all that the stream's source has now, and return what was emitted, with the batch that emitted it."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/out/b={batch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields), "batch long"])
    try:
        return spark.read.schema(schema).parquet(f"{path}/out/*")
    except AnalysisException:  # no batch was emitted
        return spark.createDataFrame([], schema)


def latest(emitted: DataFrame, keys: list[str]) -> DataFrame:
    """The last emitted row per key of an update-mode stream."""
    rest = [c for c in emitted.columns if c not in (*keys, "batch")]
    return emitted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def stream_usage(calls: DataFrame, *, late: str = "2 days") -> DataFrame:
    """Calls per key and UTC day, in update mode; days beyond the watermark are closed. Months are sums of days."""
    return calls.withWatermark("at", late).groupBy("api_key", F.window("at", "1 day")).agg(F.count("*").alias("calls")).select("api_key", F.col("window.start").alias("day"), "calls")


def stream_activity(transfers: DataFrame, *, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Transfers per wallet and window, each hash once within the watermark; slide under width makes it sliding."""
    once = transfers.withWatermark("at", late).dropDuplicatesWithinWatermark(["address", "hash"])
    return once.groupBy("address", F.window("at", width, slide or width)).agg(F.count("*").alias("tx_count")).select("address", F.col("window.start").alias("start"), "tx_count")


class _ScoreChanges(StatefulProcessor):
    """The last score of a (address, chain), until nothing has come for `keep` seconds of event time."""

    def __init__(self, min_delta: int, keep: int) -> None:
        self.min_delta, self.keep = min_delta, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, event_id long, score long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        taken = self.last.get() if self.last.exists() else None
        before, out = taken, []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            if taken is not None and (r.ts, r.event_id) <= (taken[0], taken[1]):
                continue  # late or repeated
            known = taken if taken is not None and r.ts - taken[0] <= self.keep else None  # its timer may not have come yet
            if known is None or abs(r.score - known[2]) >= self.min_delta:
                out.append((*key, r.ts, r.event_id, r.score, known[2] if known else None))
            taken = (int(r.ts), int(r.event_id), int(r.score))
        if taken is not None and taken != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((taken[0] + self.keep) * 1000)
            self.last.update(taken)
        yield pd.DataFrame(out, columns=["address", "chain", "ts", "event_id", "score", "previous"]).astype({"previous": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_score_changes(scores: DataFrame, *, min_delta: int = 10, late: str = "2 days", keep_days: int = 400) -> DataFrame:
    """First scores and changes of at least min_delta; the state of a (address, chain) is its last score.

    scores: address, chain, ts (seconds), event_id, score. Rows of a batch are taken in the order
    of (ts, event_id). A row that is not after the last one taken of its wallet changes nothing and is not
    told: it is late or a repeat; one that is beyond the watermark is dropped. A score that comes more than
    keep_days after its wallet's last is a first one again, and a wallet's state goes when the watermark
    has passed that time. The state needs the RocksDB store, which is set for the session.
    """
    scores.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = scores.select("address", "chain", "ts", "event_id", "score", F.timestamp_seconds("ts").alias("at")).withWatermark("at", late)
    schema = "address string, chain string, ts long, event_id long, score long, previous long"
    return timed.groupBy("address", "chain").transformWithStateInPandas(_ScoreChanges(min_delta, keep_days * 86400), schema, "append", "EventTime")


def stream_burst(transfers: DataFrame, *, width: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per wallet on a grid of sliding windows: the live approximation of the exact burst window."""
    return transfers.withWatermark("at", late).groupBy("address", F.window("at", width, slide)).agg(F.count("*").alias("in_window")).select("address", F.col("window.start").alias("start"), "in_window")


def stream_rescore(activity: DataFrame, rescore: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that rescores, per batch, just the wallets that the batch touched. rescore: distinct keys to scored rows."""

    def each(df: DataFrame, batch: int) -> None:
        touched = df.select("address", "chain").distinct()
        sink(rescore(touched), batch)

    return activity.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
