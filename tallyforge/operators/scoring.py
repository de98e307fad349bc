"""Model scoring: tree ensembles, linear models, calibration, score, grade, explanations.

Everything but the tree walk is Column arithmetic. Models are small driver-side objects
(a few thousand numbers) that go out with the plan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import DAY, clamp, round_half_up, sigmoid
from tallyforge.operators.features import FEATURES

# The score band, the grade cutoffs and the score deciles of the published model.
BAND = {"offset": 196.57757217918277, "factor": 104.16637676749855, "min": 300, "max": 850}
CUTOFFS = {"A": 774, "B": 643, "C": 578, "D": 452}
DECILES = [350, 475, 543, 578, 608, 628, 659, 711, 800]
# Feature families with their scale and weight.
FAMILIES = {
    "Lending History": (2.522692918777466, 0.30, list(range(9, 20)) + [30, 31, 32]),
    "Wallet History": (0.9531718492507935, 0.25, list(range(9)) + [33]),
    "DeFi Activity": (0.10857021808624268, 0.23, [20, 21, 22, 23]),
    "Portfolio & Identity": (0.12953250110149384, 0.22, list(range(24, 30))),
}
FAMILY_ERRORS = {"Lending History": ("aave", "compound"), "Wallet History": ("etherscan",), "DeFi Activity": ("uniswap",), "Portfolio & Identity": ("alchemy",)}
# Labels of the features, in feature order.
LABELS = [
    "Wallet age", "Wallet age", "DeFi tenure", "Active days", "Transaction count", "Recent activity (30d)", "Recent activity (90d)", "Recent activity (180d)", "Active months (12m)",
    "Aave borrows", "Aave repayments", "Prior Aave liquidations", "Compound borrows", "Compound repayments", "Prior Compound liquidations", "Total borrows", "Total repayments", "Repayment ratio",
    "Prior liquidations", "Has been liquidated", "Protocol breadth", "Uniswap LP", "Staked ETH", "Governance participation", "Portfolio value", "Stablecoin allocation", "Token diversity",
    "Holds ETH", "ENS name", "Gnosis Safe multisig", "Borrow velocity", "Liquidation rate", "Unpaid borrows", "DeFi tenure ratio",
]


@dataclass(frozen=True)
class Tree:
    """Arrays by node: children (-1 at a leaf), split feature and threshold, where missing values go, and the node's weight."""

    left: tuple[int, ...]
    right: tuple[int, ...]
    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    default_left: tuple[bool, ...]
    weight: tuple[float, ...]


@dataclass(frozen=True)
class Ensemble:
    trees: tuple[Tree, ...]
    base_score: float = 0.5
    n_features: int = len(FEATURES)

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margins, contributions) of rows x; all rows go down a tree level by level."""
        rows = np.arange(len(x))
        contribution = np.zeros((len(x), self.n_features))
        margin = np.full(len(x), math.log(self.base_score / (1 - self.base_score)))
        for t in self.trees:
            left, right, feature = np.array(t.left), np.array(t.right), np.array(t.feature)
            threshold, default, weight = np.array(t.threshold), np.array(t.default_left), np.array(t.weight)
            node = np.zeros(len(x), np.int64)
            margin += weight[0]
            while True:
                inner = left[node] >= 0
                if not inner.any():
                    break
                r, n = rows[inner], node[inner]
                value = x[r, feature[n]]
                goes_left = np.where(np.isnan(value), default[n], value < threshold[n])
                child = np.where(goes_left, left[n], right[n])
                step = weight[child] - weight[n]
                np.add.at(contribution, (r, feature[n]), step)
                margin[r] += step
                node[r] = child
        return margin, contribution


def score_trees(df: DataFrame, model: Ensemble, *, features: str = "features") -> DataFrame:
    """df with margin and contributions; null and NaN features take each split's default direction."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(features).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)  # null becomes NaN
            margin, parts = model.score(x)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * parts.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(margin), pa.ListArray.from_arrays(ends, pa.array(parts.ravel()))], [*names, "margin", "contributions"])

    return df.mapInArrow(run, f"{fields}, margin double, contributions array<double>")


def score_linear(df: DataFrame, *, mean: list[float], scale: list[float], coef: list[float], intercept: float, features: str = "features") -> DataFrame:
    """Standardised logistic model: df with margin and contributions; a scale of 0 counts as 1."""
    terms = [(F.coalesce(F.col(features)[i], F.lit(0.0)) - m) / (s or 1.0) * c for i, (m, s, c) in enumerate(zip(mean, scale, coef, strict=True))]
    out = df.withColumn("contributions", F.array(*terms))
    return out.withColumn("margin", F.aggregate("contributions", F.lit(float(intercept)), lambda a, x: a + x))


def calibrate(p: Column, x: list[float], y: list[float]) -> Column:
    """Piecewise-linear lookup on an ascending grid x, flat beyond its ends. On an even grid the place is computed, else searched for."""
    if any(abs((x[i + 1] - x[i]) - (x[1] - x[0])) > 1e-9 for i in range(len(x) - 1)):
        out = F.when(p <= x[0], float(y[0]))
        for x0, x1, y0, y1 in zip(x, x[1:], y, y[1:], strict=False):
            out = out.when(p < x1, y0 + (p - x0) / ((x1 - x0) or 1) * (y1 - y0))
        return out.otherwise(float(y[-1]))
    xs, ys = F.array(*(F.lit(float(v)) for v in x)), F.array(*(F.lit(float(v)) for v in y))
    step, last = x[1] - x[0], len(x) - 1
    i = F.least(F.greatest(F.floor((p - x[0]) / step).cast("int"), F.lit(0)), F.lit(last - 1))
    x0, y0, y1 = F.element_at(xs, i + 1), F.element_at(ys, i + 1), F.element_at(ys, i + 2)
    return F.when(p <= x[0], float(y[0])).when(p >= x[-1], float(y[-1])).otherwise(y0 + (p - x0) / step * (y1 - y0))


def pd_to_score(p: Column, band: dict = BAND) -> Column:
    q = clamp(p, 1e-4, 1 - 1e-4)
    return round_half_up(clamp(band["offset"] - band["factor"] * F.log(q / (1 - q)), band["min"], band["max"])).cast("long")


def grade(score: Column, cutoffs: dict = CUTOFFS) -> Column:
    out = None
    for g, least in cutoffs.items():
        out = F.when(score >= least, g) if out is None else out.when(score >= least, g)
    return out.otherwise("F")


def tier(score: Column, cutoffs: dict = CUTOFFS) -> Column:
    return F.when(score >= cutoffs["A"], "excellent").when(score >= cutoffs["B"], "good").when(score >= cutoffs["C"], "fair").otherwise("poor")


def score_percentile(score: Column, deciles: list[int] = DECILES) -> Column:
    """Interpolated between (300, 0), the deciles, and (850, 100); rounded, 1 to 100."""
    points = [(300, 0), *((d, 10 * (i + 1)) for i, d in enumerate(deciles)), (850, 100)]
    out = F.when(score <= 300, 0.0)
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        if x1 > x0:
            out = out.when(score <= x1, y0 + (score - x0) / (x1 - x0) * (y1 - y0))
    return clamp(round_half_up(out.otherwise(100.0)), 1, 100).cast("long")


def score_gates(df: DataFrame) -> DataFrame:
    """df (tx_count, first_ts, total_borrows, and the model's score, grade, percentile) with the two gates applied."""
    new = (F.coalesce("tx_count", F.lit(0)) == 0) & F.col("first_ts").isNull()
    bare = ~new & (F.coalesce("total_borrows", F.lit(0)) == 0)
    pick = lambda a, b, c: F.when(new, a).when(bare, b).otherwise(F.col(c))
    return df.withColumns({"new_wallet": new, "no_borrow_history": bare, "score": pick(300, 0, "score"), "grade": pick("F", "F", "grade"), "percentile": pick(1, 0, "percentile")})


def factor_bars(df: DataFrame, *, families: dict = FAMILIES) -> DataFrame:
    """df with factors: per family its bar (0..100, higher is safer), weight, weighted bar, and whether its sources failed."""
    bars = []
    for name, (scale, weight, members) in families.items():
        total = sum((F.col("contributions")[i] for i in members[1:]), F.col("contributions")[members[0]])
        bar = clamp(round_half_up(100 * sigmoid(-total / scale)), 0, 100)
        failed = F.lit(False)
        if "errors" in df.columns:
            for e in FAMILY_ERRORS.get(name, ()):
                failed = failed | F.coalesce(F.col("errors")[e].isNotNull(), F.lit(False))
        bars.append(F.struct(F.lit(name).alias("name"), bar.cast("long").alias("bar"), F.lit(weight).alias("weight"), (bar * weight).alias("weighted"), failed.alias("limited_data")))
    return df.withColumn("factors", F.array(*bars))


def top_contributions(df: DataFrame, *, k: int = 3, labels: list[str] = LABELS) -> DataFrame:
    """df with top_contributions: k labels that push the score up most, then k that push it down most. No shuffle."""
    by_label: dict[str, list[int]] = {}
    for i, label in enumerate(labels):
        by_label.setdefault(label, []).append(i)
    parts = []
    for label, at in by_label.items():
        impact = -F.col("contributions")[at[0]]
        for i in at[1:]:
            other = -F.col("contributions")[i]
            impact = F.when(F.abs(other) > F.abs(impact), other).otherwise(impact)
        parts.append(F.struct(F.lit(label).alias("label"), impact.alias("impact"), F.lit(at[0]).alias("at")))
    every = F.array(*parts)

    def ends(sign: int) -> Column:
        own = F.filter(every, lambda x: x["impact"] * sign > 0)
        order = F.array_sort(F.transform(own, lambda x: F.struct((-sign * x["impact"]).alias("key"), x["at"].alias("at"), x["label"].alias("label"), x["impact"].alias("impact"))))
        return F.transform(F.slice(order, 1, k), lambda x: F.struct(x["label"].alias("label"), x["impact"].alias("impact")))

    return df.withColumn("top_contributions", F.concat(ends(1), ends(-1)))


def weakest_factors(df: DataFrame, *, k: int = 3) -> DataFrame:
    """df with weakest: names of the k lowest bars; equal bars keep the family order."""
    ranked = F.array_sort(F.transform("factors", lambda f, i: F.struct(f["bar"].alias("bar"), i.alias("i"), f["name"].alias("name"))))
    return df.withColumn("weakest", F.transform(F.slice(ranked, 1, k), lambda f: f["name"]))


def score_solana(df: DataFrame, *, as_of: int) -> DataFrame:
    """Four capped factors with weights .30 .25 .25 .20 on 300..850, own cutoffs, step percentiles, the same gates."""
    # The factors' caps, points and weights
    b = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    age = F.coalesce((as_of - F.col("first_ts")) / DAY, F.lit(0.0))
    history = round_half_up(clamp(age / 730 * 50, 0, 50) + clamp(F.col("tx_count") / 500 * 30, 0, 30) + clamp(F.col("active_months_12") / 10 * 20, 0, 20))
    staking = clamp(15 * b("has_msol") + 15 * b("has_jitosol") + 10 * b("has_bsol"), 0, 40)
    portfolio = clamp(round_half_up(clamp(F.col("sol_balance") / 10 * 40, 0, 40) + clamp(F.col("token_count") / 10 * 20, 0, 20) + staking), 0, 100)
    repaid = F.when(F.col("borrow_count") > 0, round_half_up(F.least(F.lit(1.0), F.col("repay_count") / F.col("borrow_count")) * 20)).otherwise(0)
    defi = clamp(20 * b("has_jupiter") + 25 * b("has_kamino") + 20 * b("has_solend") + 20 * b("has_marginfi") + 15 * b("has_marinade") + repaid, 0, 100)
    used = sum((b(c) for c in ("has_kamino", "has_solend", "has_marginfi", "has_marinade", "has_msol", "has_jitosol")), b("has_jupiter"))
    diverse = clamp(used * 15, 0, 100)
    raw = round_half_up(300 + (history * 0.30 + portfolio * 0.25 + defi * 0.25 + diverse * 0.20) / 100 * 550)
    steps = lambda values, least: F.when(F.col("raw_score") >= 750, values[0]).when(F.col("raw_score") >= 670, values[1]).when(F.col("raw_score") >= 580, values[2]).when(F.col("raw_score") >= 500, values[3]).otherwise(least)
    new, bare = F.col("first_ts").isNull() | (F.col("tx_count") == 0), F.col("borrow_count") == 0
    gated = lambda a, c, v: F.when(new, a).when(bare, c).otherwise(v)
    out = df.withColumns({"f_history": history, "f_portfolio": portfolio, "f_defi": defi, "f_diversity": diverse, "raw_score": raw})
    return out.withColumns({"score": gated(300, 0, F.col("raw_score")).cast("long"), "grade": gated("F", "F", steps("ABCD", "F")), "percentile": gated(1, 0, steps([90, 75, 55, 35], 15)).cast("long")})
