"""Rescoring by stored state: a batch's changes are merged into each wallet's evidence, and only touched wallets are read and scored.

The state is one store for each kind of evidence (ticks, counterparties, first funders,
lending events), partitioned by wallet, and the number of wallets of each funder, partitioned
by funder. A batch rewrites the partitions that its wallets fall in. Every store takes a
batch once, by its number, so a batch that a lost job repeats is completed and not added twice.

A wallet's score depends on its own evidence and on how many wallets its funder paid first.
The latter is the only number that another wallet's activity can change; it is kept up to
date, and enters when the wallet is scored next, as in the serving path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import integrity, scoring, wallets
from tallyforge.plans.rows import small
from tallyforge.plans.scratch import materialise
from tallyforge.sources.store import Store

KEY = ["address", "chain"]


class WalletState:
    """The stored evidence of all wallets. `source` names the stream, whose batches are taken in rising order; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, *, partitions: int = 256, source: str = "activity") -> None:
        wallet = "address string, chain string"
        own = lambda name, ddl, keys, within: Store(spark, f"{path}/{name}", ddl, keys, partitions=partitions, within=within)
        self.source = source
        self.ticks = own("ticks", f"{wallet}, ts long, n long", [*KEY, "ts"], KEY)
        self.pairs = own("pairs", f"{wallet}, other string, sent long, n long", [*KEY, "other"], KEY)
        self.funders = own("funders", f"{wallet}, ts long, hash string, funder string", KEY, KEY)
        self.lending = own("lending", f"{wallet}, family string, kind string, ts long, block long, n long", integrity.LENDING, KEY)
        self.sizes = own("sizes", "funder string, wallets long", ["funder"], ["funder"])

    def take(self, transfers: DataFrame, events: DataFrame, batch: int) -> None:
        """Merge a batch of new transfers and lending events, each of them delivered once."""
        at = (self.source, batch)
        summed = lambda keys, *sums: lambda both: both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
        self.ticks.merge(integrity.ticks(transfers), summed([*KEY, "ts"], "n"), batch=at)
        self.pairs.merge(integrity.directed_pairs(transfers), summed([*KEY, "other"], "sent", "n"), batch=at)
        self.lending.merge(integrity.lending_evidence(events), summed(integrity.LENDING, "n"), batch=at)
        earliest = lambda both: both.groupBy(*KEY).agg(F.min(F.struct("ts", "hash", "funder")).alias("f")).select(*KEY, "f.*")
        now = self.funders.merge(integrity.first_funders(transfers), earliest, batch=at)
        before = self.funders.version(now.number - 1)
        changed = [p for p in now.parts if now.parts[p] != before.parts.get(p)]
        told = lambda version, n: self.funders.read(version, changed).select("funder", F.lit(n).cast("long").alias("wallets"))
        moved = told(now, 1).unionByName(told(before, -1)).groupBy("funder").agg(F.sum("wallets").alias("wallets")).where("wallets <> 0")
        self.sizes.merge(moved, lambda both: both.groupBy("funder").agg(F.sum("wallets").alias("wallets")).where("wallets > 0"), batch=at)

    def evidence(self, touched: DataFrame) -> integrity.Evidence:
        """The evidence of the touched wallets (address, chain; without repeats): their partitions alone are read, and their rows taken before anything is put together."""
        parts = self.ticks.parts_of(touched)
        keys = small(touched.select(*KEY))
        of = lambda store: store.read(parts=parts).join(keys, KEY, "left_semi")
        funders = materialise(of(self.funders), "funders")
        whose = funders.select("funder").distinct()
        sizes = self.sizes.read(parts=self.sizes.parts_of(whose)).join(small(whose), "funder", "left_semi")
        return integrity.Evidence(of(self.ticks), of(self.pairs), funders, sizes, of(self.lending))

    def rescore(self, touched: DataFrame, model: scoring.Ensemble, *, as_of: int, **given) -> DataFrame:
        """score_wallets() of the touched wallets. given: what it takes besides the histories; each table of wallets is cut down to the touched ones first."""
        keys = small(touched.select(*KEY))
        by_wallet = ("errors", "known_good", "related", "cohort", "balances", "accounts", "liquidity")
        own = {k: v.join(keys, KEY, "left_semi") if k in by_wallet and v is not None else v for k, v in given.items()}
        return wallets.score_evidence(touched, self.evidence(touched), model, as_of=as_of, **own)


def rescore_stream(activity: DataFrame, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], state: WalletState, rescore: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that merges each batch into the state and rescores the wallets that it touched.

    split: a batch to its (transfers, lending events). rescore: touched (address, chain) to scored rows.
    """

    def each(df: DataFrame, batch: int) -> None:
        transfers, events = split(materialise(df, "batch"))
        state.take(transfers, events, batch)
        touched = materialise(transfers.select(*KEY).unionByName(events.select(*KEY)).distinct(), "touched")
        sink(rescore(touched), batch)

    return activity.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
