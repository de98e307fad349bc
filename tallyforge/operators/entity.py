"""Entity resolution: pair signals from blocking keys, soft-OR, components, roll-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import DAY, round_half_up
from tallyforge.plans.cells import block_count, in_blocks, pairs_in_cells
from tallyforge.plans.graph import connected_components
from tallyforge.plans.rows import small
from tallyforge.plans.scratch import materialise
from tallyforge.operators.integrity import _directed

# Confidence of the categorical signals, and the two thresholds.
SHARED_FUNDER, GAS_FUNDING, BRIDGE = 0.6, 0.7, 0.75
MERGE, SURFACE = 0.85, 0.5
#: Ticks, and addresses, of a crowded time bucket that meet in one task.
CELL = 20_000
#: A wallet with more different times is too much for a block of addresses.
HOT_TICKS = 100_000


def build_nodes(transfers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, times): first and second sender per address; directed counts; activity times. Nodes and edges are stored: every signal reads them."""
    inbound = transfers.where((F.col("to_addr") == F.col("address")) & (F.col("from_addr") != "") & F.col("ts").isNotNull())
    early = Window.partitionBy("address").orderBy("ts", "hash")
    first = inbound.withColumn("rn", F.row_number().over(early)).where("rn <= 2").groupBy("address").agg(F.max(F.when(F.col("rn") == 1, F.col("from_addr"))).alias("funder"), F.max(F.when(F.col("rn") == 2, F.col("from_addr"))).alias("gas_funder"))
    nodes = materialise(transfers.select("address").distinct().join(first, "address", "left"), "nodes")
    edges = _directed(transfers).groupBy("address", "other").agg(F.sum("out").alias("sent"))
    return nodes, materialise(edges.where("sent > 0"), "edges"), transfers.where("ts is not null").select("address", "ts")


def shared_funder_pairs(nodes: DataFrame, *, degree_cap: int | None = None) -> DataFrame:
    """(a, b, conf) of addresses with one funder. degree_cap leaves out funders of more addresses (a hub says little); off by default."""
    own = nodes.where("funder is not null").select("address", "funder")
    if degree_cap is not None:
        own = own.join(own.groupBy("funder").agg(F.count("*").alias("n")).where(F.col("n") <= degree_cap).select("funder"), "funder", "left_semi")
    x, y = own.select(F.col("address").alias("a"), F.col("funder").alias("f")), own.select(F.col("address").alias("b"), F.col("funder").alias("g"))
    return x.join(y, (F.col("f") == F.col("g")) & (F.col("a") < F.col("b"))).select("a", "b", F.lit(SHARED_FUNDER).alias("conf"))


def shared_funder_among(nodes: DataFrame, named: DataFrame) -> DataFrame:
    """shared_funder_pairs() of the pairs (a, b) in named alone: each end's funder is looked up, so a hub costs as many rows as it has named pairs."""
    own = nodes.where("funder is not null").select("address", "funder")
    side = lambda c, f: own.select(F.col("address").alias(c), F.col("funder").alias(f))
    met = named.select("a", "b").distinct().join(side("a", "__fa"), "a").join(side("b", "__fb"), "b")
    return met.where("__fa = __fb").select("a", "b", F.lit(SHARED_FUNDER).alias("conf"))


def funder_cliques(nodes: DataFrame) -> DataFrame:
    """(funder, members, pairs, confidence): the wallets of one funder are all linked to each other; said once a funder. Its members are the nodes with that funder."""
    sizes = nodes.where("funder is not null").groupBy("funder").agg(F.count("*").alias("members")).where("members > 1")
    pairs = (F.col("members").cast("decimal(20,0)") * (F.col("members") - 1) / 2).cast("decimal(38,0)")
    return sizes.select("funder", "members", pairs.alias("pairs"), F.lit(SHARED_FUNDER).alias("confidence"))


def _named(signals: dict[str, DataFrame]) -> DataFrame | None:
    named = None
    for pairs in signals.values():
        own = pairs.where("conf > 0").select("a", "b")
        named = own if named is None else named.unionByName(own)
    return named


def resolve(nodes: DataFrame, *, times: DataFrame | None = None, floor: float = 0.0, **signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, cliques): the pairs that a signal other than the shared funder names, with all their signals, and the cliques of the funders.

    A shared funder alone surfaces a pair and never merges it. So a pair that only a clique
    holds is not written out: it has the clique's confidence and the decision `surface`. Every other pair has its row in links,
    and components and confidences are those of all pairs. Output grows with wallets and with
    named pairs, whatever the size of a hub. times: the co-spends are counted from these, where
    the pairs are scored; floor: with times, the least confidence of a link.
    """
    if SHARED_FUNDER >= MERGE:
        raise ValueError("a shared funder alone would merge")
    if times is not None:
        return merge_and_surface(linked_pairs(nodes, times, beside=True, floor=floor, **signals)), funder_cliques(nodes)
    return merge_and_surface(score_pairs(shared_funder=shared_funder_among(nodes, _named(signals)), **signals)), funder_cliques(nodes)


def _ordered(df: DataFrame, x: str, y: str, conf: float) -> DataFrame:
    return df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.lit(conf).alias("conf")).distinct()


def gas_funding_pairs(nodes: DataFrame) -> DataFrame:
    """One address paid the other's first gas; both must be nodes."""
    known = nodes.select(F.col("address").alias("known"))
    return _ordered(nodes.where("gas_funder is not null").join(known, F.col("gas_funder") == F.col("known"), "left_semi"), "address", "gas_funder", GAS_FUNDING)


def bridge_pairs(bridges: DataFrame) -> DataFrame:
    """bridges: (address, bridged_to), in either direction."""
    return _ordered(bridges, "address", "bridged_to", BRIDGE)


def direct_transfer_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both ways min(1, n / 10); one way, from 3 on, min(0.4, n / 20)."""
    known = nodes.select(F.col("address").alias("known"))
    real = edges.where("address <> other").join(known, F.col("other") == F.col("known"), "left_semi")
    up = F.col("address") < F.col("other")
    both = real.groupBy(F.least("address", "other").alias("a"), F.greatest("address", "other").alias("b")).agg(F.sum(F.when(up, F.col("sent")).otherwise(0)).alias("x"), F.sum(F.when(up, 0).otherwise(F.col("sent"))).alias("y"))
    n = F.col("x") + F.col("y")
    conf = F.when((F.col("x") > 0) & (F.col("y") > 0), F.least(F.lit(1.0), n / 10)).when(n >= 3, F.least(F.lit(0.4), n / 20)).otherwise(0.0)
    return both.select("a", "b", conf.alias("conf")).where("conf > 0")


def _grid(ticks: DataFrame, near: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the co-spend join with their cell of the bucket's grid: ticks stand in one row of it and in all columns, addresses in one column and in all rows."""
    sizes = ticks.groupBy("bucket").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m")).unionByName(near.groupBy(F.col("at").alias("bucket")).agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("m")))
    sizes = sizes.groupBy("bucket").agg(F.max("n").alias("n"), F.max("m").alias("m")).where((F.col("n") > cell) | (F.col("m") > cell))
    blocks = lambda c: F.ceil(F.col(c) / cell).cast("int")
    crowded = small(materialise(sizes.select(F.col("bucket").alias("c_bucket"), F.greatest(blocks("n"), F.lit(1)).alias("rows"), F.greatest(blocks("m"), F.lit(1)).alias("columns")), "crowded"))
    one = F.lit(1)

    def placed(df: DataFrame, bucket: str, own: str, other: str, named: tuple[str, str], *spread: str) -> DataFrame:
        met = df.join(crowded, F.col(bucket) == F.col("c_bucket"), "left")
        block = F.pmod(F.xxhash64(*spread), F.coalesce(own, one)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1))
        return met.select(*df.columns, block.alias(named[0]), every.alias(named[1]))

    return placed(ticks, "bucket", "rows", "columns", ("row", "column"), "a", "t"), placed(near, "at", "columns", "rows", ("at_column", "at_row"), "b")


def temporal_cospend_pairs(times: DataFrame, *, tolerance: int = 300, least: int = 3, among: DataFrame | None = None, cell: int = CELL, dense: bool | None = None) -> DataFrame:
    """Share of a's times with a time of b within the tolerance, over the shorter list: an interval join on time buckets.

    Equal times of an address are one tick with a count. Buckets are `tolerance` seconds wide,
    so a time of b in the tick's own bucket is close enough, and of the neighbouring buckets
    only b's last and first time matter. That is one row of b a bucket: a tick meets each b
    once, and the pairs are counted with map-side combine. A bucket in which many ticks meet many
    addresses is cut into a grid: ticks by blocks of ticks, addresses by blocks of addresses, so
    that a task gets about CELL rows of each and every pair meets in one cell. That moves a row for each
    meeting. Where these are more than the ticks times the blocks of a grid of addresses (dense: by default as counted),
    each pair is counted in one cell of that grid (plans/cells.py) and none is moved. among: pairs (a, b), a < b; with it
    only these are looked at, which joins on the pair's address and the bucket in place of the
    bucket alone (the others are lost, so it is off by default).
    """
    own = _ticks(times, tolerance, least)
    if among is None:
        busy = _Busy.of(own, None)
        if dense if dense is not None else busy.dense:
            return busy.pairs(["temporal_cospend"], tolerance=tolerance, cell=cell, plain=True).select("a", "b", F.col("confidence").alias("conf"))
        return _by_bucket(own, own, tolerance, cell)
    ticks, near = _ticks_and_near(own, own, tolerance)
    met = ticks.join(among.select("a", F.col("b").alias("other")).distinct(), "a").join(near, (F.col("other") == F.col("b")) & (F.col("bucket") == F.col("at")) & _close(tolerance))
    return _counted(met)


def _ticks(times: DataFrame, tolerance: int, least: int) -> DataFrame:
    """(address, ts, k, n, bucket), stored: different times with their counts, of addresses with `least` times."""
    busy = times.groupBy("address").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return materialise(times.groupBy("address", "ts").agg(F.count("*").alias("k")).join(busy, "address").withColumn("bucket", F.floor(F.col("ts") / tolerance)), "ticks")


def _ticks_and_near(left: DataFrame, right: DataFrame, tolerance: int) -> tuple[DataFrame, DataFrame]:
    held = right.groupBy("address", "bucket").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.first("n").alias("bn"))
    null = F.lit(None).cast("long")
    seen = lambda step, before, here, after: F.struct((F.col("bucket") + step).alias("at"), before.alias("before"), F.lit(here).alias("here"), after.alias("after"))
    near = held.select("address", "bn", F.explode(F.array(seen(-1, null, False, F.col("lo")), seen(0, null, True, null), seen(1, F.col("hi"), False, null))).alias("x")).select(F.col("address").alias("b"), "bn", "x.*")
    near = near.groupBy("b", "at").agg(F.max("before").alias("before"), F.max("here").alias("here"), F.min("after").alias("after"), F.first("bn").alias("bn"))
    return left.select(F.col("address").alias("a"), F.col("ts").alias("t"), "k", F.col("n").alias("an"), "bucket"), near


def _close(tolerance: int) -> Column:
    return F.col("here") | F.coalesce(F.col("before") >= F.col("t") - tolerance, F.lit(False)) | F.coalesce(F.col("after") <= F.col("t") + tolerance, F.lit(False))


def _counted(met: DataFrame) -> DataFrame:
    return met.groupBy("a", "b").agg(F.least(F.lit(1.0), F.sum("k") / F.least(F.first("an"), F.first("bn"))).alias("conf"))


def _by_bucket(left: DataFrame, right: DataFrame, tolerance: int, cell: int) -> DataFrame:
    """(a, b, conf) of a < b, a in left and b in right."""
    ticks, near = _grid(*_ticks_and_near(left, right, tolerance), cell)
    return _counted(ticks.join(near, (F.col("bucket") == F.col("at")) & (F.col("row") == F.col("at_row")) & (F.col("column") == F.col("at_column")) & (F.col("a") < F.col("b")) & _close(tolerance)))


@dataclass(frozen=True)
class _Busy:
    """Ticks of the wallets, and what they say about the cheaper way to their pairs."""

    own: DataFrame
    nodes: DataFrame | None
    wallets: int
    ticks: int
    meetings: float
    hot: int
    since: int
    span: int

    @staticmethod
    def of(own: DataFrame, nodes: DataFrame | None) -> _Busy:
        a = own.groupBy("address").agg(F.count("*").alias("n")).agg(F.count("*"), F.sum((F.col("n") > HOT_TICKS).cast("long"))).first()
        b = own.groupBy("bucket").agg(F.count("*").cast("double").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n")), F.min("lo"), F.max("hi")).first()
        return _Busy(own, nodes, max(a[0], nodes.count() if nodes is not None else 0), int(b[0] or 0), 1.5 * (b[1] or 0), a[1] or 0, b[2] or 0, (b[3] or 0) - (b[2] or 0))

    @property
    def dense(self) -> bool:
        """Whether ticks meet more often than they would be sent out to the cells of a grid of address blocks."""
        return self.meetings > (self.ticks + self.wallets) * block_count(self.wallets, self.ticks)

    def pairs(self, signals: list[str], named: DataFrame | None = None, *, tolerance: int = 300, cell: int = CELL, shared: float | None = None, beside: bool = False, floor: float = 0.0, plain: bool = False) -> DataFrame:
        """pairs_in_cells() of all wallets. Pairs with a wallet of very many ticks, which would not fit its block, come by buckets and are named to the cells."""
        cold = self.own
        if self.hot:
            which = F.broadcast(self.own.groupBy("address").agg(F.count("*").alias("n")).where(F.col("n") > HOT_TICKS).select("address"))  # fewer than ticks / HOT_TICKS
            hot, cold = self.own.join(which, "address", "left_semi"), self.own.join(which, "address", "left_anti")
            far = _by_bucket(hot, self.own, tolerance, cell).unionByName(_by_bucket(cold, hot, tolerance, cell)).select("a", "b", F.lit(signals.index("temporal_cospend")).alias("signal"), "conf")
            named = far if named is None else named.unionByName(far)
        each = cold.where("address is not null").groupBy("address").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct((F.col("ts") - self.since).cast("int" if self.span < 2**31 else "long").alias("ts"), "k"))).alias("x"))
        each = each.select("address", "n", F.col("x.ts").alias("ts"), F.when(F.exists("x", lambda e: e["k"] > 1), F.col("x.k")).alias("k"))
        known = self.own.select("address").distinct() if self.nodes is None else self.nodes.select("address", "funder")
        known = known.where("address is not null") if self.nodes is not None else known.where("address is not null").withColumn("funder", F.lit(None).cast("string"))
        blocks, n = in_blocks(known.join(each, "address", "left"), self.wallets, self.ticks)
        return pairs_in_cells(blocks, n, named, signals, tolerance=tolerance, shared=shared, beside=beside, floor=floor, plain=plain)


def linked_pairs(nodes: DataFrame, times: DataFrame, *, beside: bool = False, floor: float = 0.0, tolerance: int = 300, least: int = 3, dense: bool | None = None, **signals: DataFrame) -> DataFrame:
    """score_pairs() of the shared funders of nodes, the co-spends of times, and the other signals; a signal names a pair once, and only nodes have times.

    Where most wallets meet, the pairs are as many as the wallets' square, and moving them would cost far more than
    the tables. Then every pair is scored in the one task that counts its co-spends. beside: without
    the pairs that a shared funder alone names. floor: least confidence, at nine decimals.
    """
    busy = _Busy.of(_ticks(times, tolerance, least), nodes)
    if dense if dense is not None else busy.dense:
        names = sorted([*signals, "shared_funder", "temporal_cospend"])
        named = None
        for name, pairs in signals.items():
            own = pairs.where("conf > 0").select("a", "b", F.lit(names.index(name)).alias("signal"), F.col("conf").cast("double").alias("conf"))
            named = own if named is None else named.unionByName(own)
        outside = None
        if named is not None:
            named = materialise(named, "named")
            known = nodes.select(F.col("address").alias("known"))
            far = named.join(known, F.col("a") == F.col("known"), "left_anti").unionByName(named.join(known, F.col("a") == F.col("known"), "left_semi").join(known, F.col("b") == F.col("known"), "left_anti"))
            outside = score_pairs(**{name: far.where(F.col("signal") == names.index(name)) for name in signals})
        got = busy.pairs(names, named, tolerance=tolerance, shared=SHARED_FUNDER, beside=beside, floor=floor)
        told = F.filter(F.array(*(F.when(F.col("told").bitwiseAND(1 << s) != 0, name) for s, name in enumerate(names))), lambda x: x.isNotNull())
        links = got.select("a", "b", "confidence", told.alias("signals"), "n_signals")
        links = links if outside is None else links.unionByName(outside)
    else:
        all_of = {**signals, "temporal_cospend": _by_bucket(busy.own, busy.own, tolerance, CELL)}
        links = score_pairs(shared_funder=shared_funder_among(nodes, _named(all_of)) if beside else shared_funder_pairs(nodes), **all_of)
    return links.where(F.round("confidence", 9) >= floor) if floor else links


def score_pairs(**signals: DataFrame) -> DataFrame:
    """(a, b, confidence, signals, n_signals): 1 - prod(1 - conf) over the signals that a pair has."""
    each = None
    for name, pairs in sorted(signals.items()):
        own = pairs.where("conf > 0").select("a", "b", F.struct(F.lit(name).alias("signal"), F.col("conf").cast("double").alias("conf")).alias("s"))
        each = own if each is None else each.unionByName(own)
    got = each.groupBy("a", "b").agg(F.array_sort(F.collect_list("s")).alias("signals"))
    kept = F.aggregate("signals", F.lit(1.0), lambda acc, s: acc * (1 - s["conf"]))
    return got.select("a", "b", (1 - kept).alias("confidence"), F.transform("signals", lambda s: s["signal"]).alias("signals"), F.size("signals").alias("n_signals")).where("confidence > 0")


def merge_and_surface(links: DataFrame, *, min_signals: int = 1) -> DataFrame:
    """links with decision: merge, surface or none. Confidences are compared at nine decimals, so a product that should reach a threshold does; the column stays as it came."""
    at_nine = F.round("confidence", 9)
    merge = (at_nine >= MERGE) & (F.col("n_signals") >= min_signals)
    return links.withColumn("decision", F.when(merge, "merge").when(at_nine >= SURFACE, "surface").otherwise("none"))


def cluster(links: DataFrame) -> DataFrame:
    """(entity_id, address, size, cohesion) of components of at least two over the merge links; id is the smallest address."""
    merged = materialise(links.where("decision = 'merge'").select("a", "b", "confidence"), "merge-links")
    members = materialise(connected_components(merged), "members").select(F.col("node").alias("address"), F.col("component").alias("entity_id"))
    tight = merged.join(members, F.col("a") == F.col("address")).select("entity_id", "confidence", F.lit(0).alias("member"))
    sums = tight.unionByName(members.select("entity_id", F.lit(None).cast("double").alias("confidence"), F.lit(1).alias("member"))).groupBy("entity_id").agg(F.sum("member").alias("size"), F.min("confidence").alias("cohesion"))
    return members.join(sums, "entity_id").select("entity_id", "address", "size", "cohesion")


def entity_scores(members: DataFrame, *, now: int, half_life_days: int = 180) -> DataFrame:
    """Rounded mean score per entity, weighted by activity and recency; a single member keeps its score. members: entity_id, score, activity, last_active_ts."""
    weight = F.greatest("activity", F.lit(1)) * F.pow(F.lit(0.5), F.greatest(F.lit(0), now - F.col("last_active_ts")) / (half_life_days * DAY))
    sums = members.withColumn("w", weight).groupBy("entity_id").agg(F.count("*").alias("n"), F.max("score").alias("one"), F.sum(F.col("w") * F.col("score")).alias("ws"), F.sum("w").alias("w"), F.avg("score").alias("plain"))
    return sums.select("entity_id", F.col("n").alias("members"), F.when(F.col("n") == 1, F.col("one")).otherwise(round_half_up(F.when(F.col("w") > 0, F.col("ws") / F.col("w")).otherwise(F.col("plain")))).cast("long").alias("score"))


def merge_audit(log: DataFrame) -> DataFrame:
    """Current membership from an append-only log (entity_id, address, action, at, seq): the latest action is not a removal."""
    last = log.groupBy("entity_id", "address").agg(F.max(F.struct("at", "seq", "action")).alias("x"))
    return last.where(~F.col("x.action").isin("removed", "reversed")).select("entity_id", "address", F.col("x.at").alias("since"))
