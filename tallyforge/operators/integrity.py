"""Detectors of manufactured history, their combination, and the penalty.

Transfers are (address, chain, hash, ts, from_addr, to_addr); `related` is (address,
chain, other). Keys are wallets or (wallet, counterparty), sums combine on the map side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import DAY, clamp, count_if, round_half_up

KEY = ["address", "chain"]
# Weight of each detector.
WEIGHTS = {"wash_trading": 1.0, "sybil_funding": 0.8, "burst_timing": 0.7, "instant_repay": 0.5}


def _directed(transfers: DataFrame) -> DataFrame:
    """(address, chain, other, out): transfers with a counterparty; a transfer to oneself counts as outgoing."""
    me = F.col("address")
    sent = (F.col("from_addr") == me) & F.col("to_addr").isNotNull() & (F.col("to_addr") != "")
    got = (F.col("to_addr") == me) & F.col("from_addr").isNotNull() & (F.col("from_addr") != "")
    return transfers.select(*KEY, F.when(sent, F.col("to_addr")).when(got, F.col("from_addr")).alias("other"), F.when(sent, 1).when(got, 0).alias("out")).where("out is not null")


def directed_pairs(transfers: DataFrame) -> DataFrame:
    """(address, chain, other, sent, n): transfers with each counterparty. Parts of a history are put together by sums."""
    return _directed(transfers).groupBy(*KEY, "other").agg(F.sum("out").cast("long").alias("sent"), F.count("*").alias("n"))


def ticks(transfers: DataFrame) -> DataFrame:
    """(address, chain, ts, n): transfers at each time, null if unknown. Parts of a history are put together by sums."""
    return transfers.groupBy(*KEY, "ts").agg(F.count("*").alias("n"))


def first_funders(transfers: DataFrame) -> DataFrame:
    """(address, chain, ts, hash, funder): the earliest known sender to each wallet. Parts of a history are put together by the least (ts, hash)."""
    inbound = transfers.where((F.col("to_addr") == F.col("address")) & (F.col("from_addr") != "") & F.col("ts").isNotNull())
    return inbound.groupBy(*KEY).agg(F.min(F.struct("ts", "hash", F.col("from_addr").alias("funder"))).alias("f")).select(*KEY, "f.*")


def funder_sizes(funders: DataFrame) -> DataFrame:
    """(funder, wallets): how many wallets each one funded first."""
    return funders.groupBy("funder").agg(F.count("*").alias("wallets"))


def wash_trading(transfers: DataFrame, related: DataFrame | None = None, *, least: float = 4) -> DataFrame:
    """Share of a wallet's directed transfers that run both ways with a partner (0.6 each, 1 if related)."""
    return wash_of_pairs(directed_pairs(transfers), related, least=least)


def wash_of_pairs(pairs: DataFrame, related: DataFrame | None = None, *, least: float = 4) -> DataFrame:
    """wash_trading() of directed_pairs()."""
    weight = F.lit(0.6)
    if related is not None:
        pairs = pairs.join(related.select(*KEY, "other", F.lit(True).alias("known")).distinct(), [*KEY, "other"], "left")
        weight = F.when(F.col("known"), 1.0).otherwise(0.6)
    both = (F.col("sent") > 0) & (F.col("sent") < F.col("n"))
    sums = pairs.groupBy(*KEY).agg(F.sum("n").alias("directed"), count_if(both).alias("partners"), F.sum(F.when(both, F.col("n") * weight).otherwise(0.0)).alias("weighted"))
    share = F.least(F.lit(1.0), F.col("weighted") / F.col("directed"))
    return sums.withColumn("severity", F.when((F.col("partners") >= 1) & (F.col("weighted") >= least), share).otherwise(0.0))


def sybil_funding(transfers: DataFrame, cohort: DataFrame | None = None) -> DataFrame:
    """The earliest sender to a wallet, and cohort / 10 (at most 1). cohort: (address, chain, cohort); else the wallets with the same funder, less itself."""
    funders = first_funders(transfers)
    return sybil_of_funders(funders, funder_sizes(funders), cohort)


def sybil_of_funders(funders: DataFrame, sizes: DataFrame, cohort: DataFrame | None = None) -> DataFrame:
    """sybil_funding() of first_funders(), with the sizes of at least these funders."""
    funded = funders.select(*KEY, "funder")
    if cohort is None:
        met = funded.join(sizes.select("funder", (F.col("wallets") - 1).alias("cohort")), "funder")
    else:
        met = funded.join(cohort, KEY, "left").fillna(0, ["cohort"])
    return met.withColumn("severity", F.least(F.lit(1.0), F.col("cohort") / 10)).select(*KEY, "funder", "cohort", "severity")


def burst_timing(transfers: DataFrame, *, days: int = 7) -> DataFrame:
    """How far the busiest `days` exceed an even spread; equal times are counted together before the window."""
    return burst_of_ticks(ticks(transfers), days=days)


def burst_of_ticks(ticks: DataFrame, *, days: int = 7) -> DataFrame:
    """burst_timing() of ticks().

    Time is cut into buckets as wide as the window, so a window that ends at a tick lies in the
    tick's bucket and the one before. Each bucket of a wallet gets its own ticks, those of the
    bucket before, and for each own tick a mark where its window begins; one running sum then gives
    every window as a difference. No task holds more of a wallet than two buckets, which
    have one row a second at most.
    """
    width = days * DAY
    known = ticks.where("ts is not null").select(*KEY, "ts", F.col("n").alias("k"))
    bucket = F.floor(F.col("ts") / width)
    row = lambda at, bucket, side, k, tick: F.struct(at.alias("at"), bucket.alias("bucket"), F.lit(side).alias("side"), k.alias("k"), tick.alias("tick"))
    none = F.lit(None).cast("long")
    rows = F.array(row(F.col("ts"), bucket, 1, F.col("k"), F.col("ts")), row(F.col("ts"), bucket + 1, 1, F.col("k"), none), row(F.col("ts") - width, bucket, 0, F.lit(0).cast("long"), F.col("ts")))
    each = known.select(*KEY, F.explode(rows).alias("x")).select(*KEY, "x.*")
    until = Window.partitionBy(*KEY, "bucket").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = each.withColumn("sum", F.sum("k").over(until)).where("tick is not null")
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("sum")))
    windows = summed.groupBy(*KEY, "bucket", "tick").agg(F.max("k").alias("k"), (at(1) - at(0)).alias("in_window"))
    peaks = windows.groupBy(*KEY).agg(F.sum("k").alias("n"), F.max("in_window").alias("peak"), (F.max("tick") - F.min("tick")).alias("span"))
    even = (F.col("peak") - F.col("n") * width / F.col("span")) / F.col("n")
    return peaks.withColumn("severity", F.when(F.col("n") < 4, 0.0).when(F.col("span") <= width, 1.0).otherwise(clamp(even, 0.0, 1.0)))


def _levels(blocks: int) -> range:
    return range((blocks + 1).bit_length())


def _spans_of(block: Column, blocks: int) -> Column:
    """(level, span): the spans of 2**level blocks that a block lies in, up to blocks + 1 long."""
    return F.array(*(F.struct(F.lit(j).alias("level"), F.floor(block / 2**j).alias("span")) for j in _levels(blocks)))


def _spans_from(block: Column, blocks: int) -> Column:
    """(level, span): block to block + blocks, both included, as at most two such spans a level."""
    parts = []
    for j in _levels(blocks):
        lo, hi = F.ceil(block / 2**j), F.floor((block + (blocks + 1)) / 2**j)  # what the levels below leave, without hi
        for taken, span in ((F.pmod(lo, F.lit(2)) == 1, lo), (F.pmod(hi, F.lit(2)) == 1, hi - 1)):
            parts.append(F.when((lo < hi) & taken, F.struct(F.lit(j).alias("level"), span.alias("span"))))
    return F.array_compact(F.array(*parts))


def instant_repay(events: DataFrame, *, seconds: int = 60, blocks: int | None = 1, copies: str | None = None) -> DataFrame:
    """Share of borrows that a repay follows within `seconds`, or within `blocks` where both blocks are known.

    Of the repays in a bucket of `seconds` only the first and the last matter: a borrow is
    followed in its own bucket if that one's last repay is not before it, and in the next if that
    one's first repay is near enough. Of blocks only the last repay matters, kept for each span of
    1, 2, 4 ... blocks that starts at a multiple of its length; a borrow's blocks are a few such
    spans. So borrows meet sums of repays, a row costs rows by the logarithm of `blocks`, and no wallet is
    held by one task. copies: a column with the number of equal events that a row stands for.
    """
    times = F.col(copies) if copies else F.lit(1).cast("long")
    borrows = events.where("kind = 'borrow'").select(*KEY, "ts", *(["block"] if blocks is not None else []), times.alias("k"), F.floor(F.col("ts") / seconds).alias("bucket"))
    repays = events.where("kind = 'repay' and ts is not null")
    ends = repays.groupBy(*KEY, F.floor(F.col("ts") / seconds).alias("bucket")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))

    def met(df: DataFrame, other: DataFrame, at: list[str], how: str) -> DataFrame:
        """df with what the other table has for its wallet and place; null wallets are wallets too."""
        named = other.withColumnsRenamed({c: f"__{c}" for c in (*KEY, *at)})
        on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in KEY] + [F.col(c) == F.col(f"__{c}") for c in at]
        return df.join(named, on, how).drop(*(f"__{c}" for c in (*KEY, *at)))

    around = ends.select(*KEY, F.explode(F.array(F.struct("bucket", "last", F.lit(None).cast("long").alias("after")), F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(None).cast("long").alias("last"), F.col("first").alias("after")))).alias("x")).select(*KEY, "x.*")
    around = around.groupBy(*KEY, "bucket").agg(F.max("last").alias("last"), F.min("after").alias("after"))
    own = met(borrows, around, ["bucket"], "left")
    fast = F.coalesce(F.col("last") >= F.col("ts"), F.lit(False)) | F.coalesce(F.col("after") - F.col("ts") <= seconds, F.lit(False))
    own = own.withColumn("fast", fast)
    if blocks is not None:
        spans = repays.where("block is not null").select(*KEY, "ts", F.explode(_spans_of(F.col("block"), blocks)).alias("x")).groupBy(*KEY, "x.level", "x.span").agg(F.max("ts").alias("near"))
        asked = borrows.where("block is not null").select(*KEY, "ts", "block").distinct().withColumn("x", F.explode(_spans_from(F.col("block"), blocks))).select(*KEY, "ts", "block", "x.*")
        told = met(asked, spans, ["level", "span"], "inner").where("near >= ts").select(*KEY, "ts", "block", F.lit(0).cast("long").alias("k"), F.lit(True).alias("fast"))
        own = own.select(*KEY, "ts", "block", "k", "fast").unionByName(told).groupBy(*KEY, "ts", "block").agg(F.sum("k").alias("k"), F.max("fast").alias("fast"))
    fast = F.col("fast")
    sums = own.groupBy(*KEY).agg(F.sum("k").alias("borrows"), F.sum(F.when(fast, F.col("k")).otherwise(0)).alias("instant"))
    return sums.withColumn("severity", F.col("instant") / F.col("borrows"))


def combine_signals(df: DataFrame, *, weights: dict = WEIGHTS) -> DataFrame:
    """df (a severity column per detector) with penalty = 1 - prod(1 - severity * weight), and flagged."""
    kept = F.lit(1.0)
    for name, w in weights.items():
        kept = kept * (1 - clamp(F.coalesce(F.col(name), F.lit(0.0)), 0.0, 1.0) * w)
    return df.withColumn("penalty", 1 - kept).withColumn("flagged", F.col("penalty") >= 0.5)


def apply_penalty(df: DataFrame) -> DataFrame:
    """df with penalised_score: at most 250 points off, not below 300; new wallets and those without borrows are left."""
    off = F.greatest(F.lit(300), F.col("score") - round_half_up(250 * F.coalesce("penalty", F.lit(0.0))))
    return df.withColumn("penalised_score", F.when(F.col("new_wallet") | F.col("no_borrow_history"), F.col("score")).otherwise(off).cast("long"))


def detect(transfers: DataFrame, events: DataFrame, related: DataFrame | None = None, cohort: DataFrame | None = None, *, live_parity: bool = False) -> DataFrame:
    """One row per wallet with all severities, penalty and flag; live_parity keeps the two detectors that serving runs.

    related, cohort: what wash_trading() and sybil_funding() take of the resolved entities.
    """
    return detect_evidence(Evidence.of(transfers, events), related, cohort, live_parity=live_parity)


@dataclass(frozen=True)
class Evidence:
    """What features and detectors need of histories, by wallet, in a form that parts of a history can be added to.

    lending: address, chain, family, kind, ts, block, n (equal events). sizes: of the funders in
    `funders` at least, over all wallets.
    """

    ticks: DataFrame
    pairs: DataFrame
    funders: DataFrame
    sizes: DataFrame
    lending: DataFrame

    @staticmethod
    def of(transfers: DataFrame, events: DataFrame) -> Evidence:
        funders = first_funders(transfers)
        return Evidence(ticks(transfers), directed_pairs(transfers), funders, funder_sizes(funders), lending_evidence(events))


LENDING = [*KEY, "family", "kind", "ts", "block"]


def lending_evidence(events: DataFrame) -> DataFrame:
    """Lending events with equal ones counted."""
    if "block" not in events.columns:
        events = events.withColumn("block", F.lit(None).cast("long"))
    return events.groupBy(*LENDING).agg(F.count("*").alias("n"))


def detect_evidence(found: Evidence, related: DataFrame | None = None, cohort: DataFrame | None = None, *, live_parity: bool = False) -> DataFrame:
    """detect() of evidence."""
    parts = {"wash_trading": wash_of_pairs(found.pairs, related), "burst_timing": burst_of_ticks(found.ticks)}
    if not live_parity:
        parts |= {"sybil_funding": sybil_of_funders(found.funders, found.sizes, cohort), "instant_repay": instant_repay(found.lending, copies="n")}
    each = None
    for name, part in parts.items():
        own = part.select(*KEY, F.lit(name).alias("detector"), F.col("severity").cast("double").alias("severity"))
        each = own if each is None else each.unionByName(own)
    severity = lambda name: F.coalesce(F.max(F.when(F.col("detector") == name, F.col("severity"))), F.lit(0.0)).alias(name)
    return combine_signals(each.groupBy(*KEY).agg(*(severity(name) for name in WEIGHTS)))
