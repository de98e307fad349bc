"""Pairs of wallets counted where they are written: a grid of address blocks in which no pair leaves its task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.plans.prefix import running_sums
from tallyforge.plans.scratch import materialise

#: Wallets of a block at most, and ticks, about.
WALLETS, TICKS = 4000, 1_000_000
#: Cells of one dense table, and meetings of ticks in one array.
DENSE, MEETINGS = 500_000, 2_000_000
#: A row is a wallet of one of the cell's two blocks, or a pair of them that a signal (by its place in the list) names.
COLUMNS = ["block", "address", "funder", "n", "ts", "k", "other", "signal", "conf"]
OUT = "a string, b string, confidence double, told int, n_signals int"


def block_count(wallets: int, ticks: int) -> int:
    """Blocks for so many wallets and ticks; small tables get a few too, so that their cells are shared out."""
    return max(-(-wallets // WALLETS) + ticks // TICKS, min(8, -(-wallets // 100)), 1)


def in_blocks(wallets: DataFrame, count: int, ticks: int) -> tuple[DataFrame, int]:
    """wallets (address, funder, n, ts, k), stored, with their block, and the number of blocks.

    Blocks follow the order of addresses, by running sums of a weight that is shared by
    the wallets and their ticks, so that each block has its share of both at most.
    """
    blocks = block_count(count, ticks)
    own = max(1, -(-count // blocks))
    unit = max(1, TICKS // own)
    weighed = wallets.withColumns({"weight": F.coalesce(F.size("ts"), F.lit(0)).cast("long") + unit, "all": F.lit(0)})
    placed = materialise(running_sums(weighed, ["all"], "address", ["weight"]).withColumn("block", F.floor(F.col("before_weight") / (own * unit)).cast("int")).drop("all", "weight", "before_weight"), "blocks")
    return placed, (placed.agg(F.max("block")).first()[0] or 0) + 1


def pairs_in_cells(blocks: DataFrame, n: int, named: DataFrame | None, signals: list[str], **options) -> DataFrame:
    """OUT of all pairs a < b that have a signal. named: (a, b, signal, conf) of pairs of these wallets.

    A cell is a pair of blocks. Its task gets both blocks' wallets with their ticks, so a wallet goes
    out once a block, and a pair's meetings are counted and its signals put together there.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    null = {c: F.lit(None).cast(kind) for c, kind in [*blocks.dtypes, ("other", "string"), ("signal", "int"), ("conf", "double")]}
    rows = blocks.withColumn("__x", every).withColumns({c: null[c] for c in ("other", "signal", "conf")} | {"i": F.least("block", "__x"), "j": F.greatest("block", "__x")}).select("i", "j", *COLUMNS)
    if named is not None:
        side = lambda c, at: blocks.select(F.col("address").alias(c), F.col("block").alias(at))
        met = named.join(side("a", "i"), "a").join(side("b", "j"), "b")
        rows = rows.unionByName(met.withColumns(null | {"address": F.col("a"), "other": F.col("b"), "signal": F.col("signal"), "conf": F.col("conf")}).select("i", "j", *COLUMNS))
    dealt = rows.repartition(max(1, min(n * (n + 1) // 2, 1000)), "i", "j")
    return dealt.groupBy("i", "j").applyInArrow(_cell(signals, **options), OUT)


def _cell(signals: list[str], *, tolerance: int, shared: float | None, beside: bool, floor: float, plain: bool) -> Callable:
    """The function of a cell. shared: confidence of a shared funder, if it is a signal. beside: pairs that it alone names are left out. floor: least confidence (about). plain: the co-spend's own confidence in place of the soft-OR."""
    order = sorted(range(len(signals)), key=lambda s: signals[s])
    cospend, funder = (signals.index(s) if s in signals else -1 for s in ("temporal_cospend", "shared_funder"))

    def pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        i, j = (k.as_py() for k in key)
        wallets, named = table.filter(pc.is_null(table["other"])), table.filter(pc.is_valid(table["other"]))
        x = _Side(wallets.filter(pc.equal(wallets["block"], i)))
        y = x if i == j else _Side(wallets.filter(pc.equal(wallets["block"], j)))
        if not x.size or not y.size:
            return
        u, of, before = y.by_time()
        funders = pc.unique(pa.chunked_array([*x.funder.chunks, *y.funder.chunks], pa.string())).drop_null()
        fx, fy = x.codes(x.funder, funders), y.codes(y.funder, funders)
        na, nb, ns, nc = x.codes(named["address"], x.names), y.codes(named["other"], y.names), named["signal"].to_numpy(), named["conf"].to_numpy()
        step = max(1, DENSE // y.size)
        for lo in range(0, x.size, step):
            hi = min(x.size, lo + step)
            shape = (hi - lo, y.size)
            near = _meetings(x, lo, hi, u, of, before, y.size, tolerance) if cospend >= 0 else np.zeros(shape)
            near = np.where(near > 0, np.minimum(1.0, near / np.maximum(1, np.minimum(x.n[lo:hi, None], y.n[None, :]))), 0.0)
            kept, told, many = np.ones(shape), np.zeros(shape, np.int32), np.zeros(shape, np.int32)
            here = (na >= lo) & (na < hi)
            for s in order:
                if s == cospend:
                    kept *= 1 - near
                    told |= (near > 0).astype(np.int32) << s
                    many += near > 0
                if s == funder and shared:
                    same = (fx[lo:hi, None] == fy[None, :]) & (fx[lo:hi, None] >= 0)
                    kept = np.where(same, kept * (1 - shared), kept)
                    told |= same.astype(np.int32) << s
                    many += same
                mine = here & (ns == s)
                if mine.any():
                    at = (na[mine] - lo, nb[mine])
                    np.multiply.at(kept, at, 1 - nc[mine])
                    np.add.at(many, at, 1)
                    np.bitwise_or.at(told, at, np.int32(1 << s))
                    if plain:
                        near[at] = nc[mine]
            value = near if plain else 1 - kept
            good = (value > 0) & (value >= floor - 1e-8)
            if beside and funder >= 0:
                good &= (told & ~np.int32(1 << funder)) != 0
            if i == j:
                good &= np.arange(lo, hi)[:, None] < np.arange(y.size)[None, :]
            r, c = np.nonzero(good)
            if len(r):
                yield pa.RecordBatch.from_arrays([x.names.take(pa.array(r + lo)), y.names.take(pa.array(c)), pa.array(value[r, c]), pa.array(told[r, c]), pa.array(many[r, c])], ["a", "b", "confidence", "told", "n_signals"])

    return pairs


class _Side:
    """The wallets of one block by address, and their ticks one after the other."""

    def __init__(self, wallets: pa.Table) -> None:
        t = wallets.sort_by("address").combine_chunks()
        self.size = t.num_rows
        self.names = pa.concat_arrays([*t["address"].chunks, pa.array([], pa.string())])
        self.funder = t["funder"]
        self.n = t["n"].fill_null(0).to_numpy()
        lengths = pc.fill_null(pc.list_value_length(t["ts"]), 0).to_numpy().astype(np.int64)
        self.of = np.repeat(np.arange(self.size), lengths)
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        self.ts = pc.list_flatten(t["ts"]).to_numpy().astype(np.int64)
        # k is null where all of a wallet's ticks count once
        counted = np.repeat(pc.fill_null(pc.list_value_length(t["k"]), 0).to_numpy() > 0, lengths)
        self.k = np.ones(len(self.ts), np.int64)
        self.k[counted] = pc.list_flatten(t["k"]).to_numpy()

    @staticmethod
    def codes(values: pa.ChunkedArray, among: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy().astype(np.int64)

    def by_time(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Times in order, whose they are, and each wallet's time before."""
        before = np.concatenate(([0], self.ts[:-1])) if len(self.ts) else self.ts.copy()
        first = self.starts[:-1][np.diff(self.starts) > 0]
        before[first] = np.iinfo(np.int64).min
        order = np.argsort(self.ts, kind="stable")
        return self.ts[order], self.of[order], before[order]


def _meetings(x: _Side, lo: int, hi: int, u: np.ndarray, of: np.ndarray, before: np.ndarray, width: int, tolerance: int) -> np.ndarray:
    """How many times of each wallet of x from lo to hi have a time of each other wallet within the tolerance: counted at the first such time, which has none before it that is near too."""
    out = np.zeros((hi - lo) * width)
    own = slice(x.starts[lo], x.starts[hi])
    t, k, who = x.ts[own], x.k[own], x.of[own] - lo
    begin, end = np.searchsorted(u, t - tolerance, "left"), np.searchsorted(u, t + tolerance, "right")
    total = np.concatenate(([0], np.cumsum(end - begin)))
    at = 0
    while at < len(t):
        to = max(at + 1, int(np.searchsorted(total, total[at] + MEETINGS, "right")) - 1)
        count = end[at:to] - begin[at:to]
        which = np.repeat(np.arange(at, to), count)
        met = np.arange(len(which)) - np.repeat(total[at:to] - total[at], count) + np.repeat(begin[at:to], count)
        first = before[met] < t[which] - tolerance
        which, met = which[first], met[first]
        out += np.bincount(who[which] * width + of[met], weights=k[which], minlength=len(out))
        at = to
    return out.reshape(hi - lo, width)
