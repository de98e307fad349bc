"""Detectors, as-of lookups and point-in-time features with one wallet that owns nearly all rows, against plain loops."""

import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import features, integrity, labels
from tallyforge.plans import prefix

DAY = 86400
HOT = "whale"


def wallet(rng):
    return HOT if rng.random() < 0.9 else rng.choice(["a", "b", "c", None])


def test_burst_equals_plain_windows(spark):
    rng, rows = random.Random(1), []
    for _ in range(3000):
        w = wallet(rng)
        rows.append((w, "base", rng.choice([None, 1_600_000_000 + rng.randrange(400 * DAY), 1_600_000_000 + rng.randrange(60) * 7 * DAY, -rng.randrange(9 * DAY)])))
    want = {}
    for w in {r[0] for r in rows}:
        ts = sorted(t for x, _, t in rows if x == w and t is not None)
        n, span = len(ts), ts[-1] - ts[0]
        peak = max(bisect_right(ts, t) - bisect_right(ts, t - 7 * DAY - 1) for t in ts)
        want[w] = (n, peak, 0.0 if n < 4 else 1.0 if span <= 7 * DAY else min(1.0, max(0.0, (peak - n * 7 * DAY / span) / n)))
    df = spark.createDataFrame(rows, "address string, chain string, ts long")
    got = {r.address: (r.n, r.peak, r.severity) for r in integrity.burst_timing(df).collect()}
    assert {w: x[:2] for w, x in got.items()} == {w: x[:2] for w, x in want.items()} and all(got[w][2] == pytest.approx(want[w][2]) for w in want)
    plan = integrity.burst_timing(df)._jdf.queryExecution().optimizedPlan().toString()
    assert all("bucket#" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window "))


@pytest.mark.parametrize(("seconds", "blocks"), [(60, 1), (7, None), (1, 3)])
def test_instant_repay_equals_plain_loops(spark, seconds, blocks):
    rng, rows = random.Random(2), []
    for _ in range(1200):
        rows.append((wallet(rng), "base", rng.choice(["borrow", "repay", "liquidation"]), rng.randrange(-400, 6000), rng.choice([None, rng.randrange(400)])))
    want = {}
    for w in {r[0] for r in rows}:
        borrows = [r for r in rows if r[0] == w and r[2] == "borrow"]
        hit = 0
        for _, _, _, t, b in borrows:
            hit += any(x[0] == w and x[2] == "repay" and x[3] >= t and (x[3] - t <= seconds or (blocks is not None and None not in (b, x[4]) and 0 <= x[4] - b <= blocks)) for x in rows)
        if borrows:
            want[w] = (len(borrows), hit)
    df = spark.createDataFrame(rows, "address string, chain string, kind string, ts long, block long")
    out = integrity.instant_repay(df, seconds=seconds, blocks=blocks)
    assert {r.address: (r.borrows, r.instant) for r in out.collect()} == want
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("blocks", [0, 2400, 10**10])
def test_wide_block_limits_cost_a_few_rows_a_repay(spark, blocks):
    rng, far = random.Random(7), 3 * (blocks + 1)
    rows = [(wallet(rng), "base", rng.choice(["borrow", "repay"]), rng.randrange(10**6), rng.choice([None, -5, rng.randrange(-far, far)])) for _ in range(700)]
    want = {}
    for w, _, kind, t, b in rows:
        if kind == "borrow":
            hit = any(x[0] == w and x[2] == "repay" and x[3] >= t and (x[3] - t <= 1 or None not in (b, x[4]) and 0 <= x[4] - b <= blocks) for x in rows)
            want[w] = (want.get(w, (0, 0))[0] + 1, want.get(w, (0, 0))[1] + hit)
    df = spark.createDataFrame(rows, "address string, chain string, kind string, ts long, block long")
    out = integrity.instant_repay(df, seconds=1, blocks=blocks)
    assert {r.address: (r.borrows, r.instant) for r in out.collect()} == want
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_as_of_join_spreads_one_wallet_and_equals_plain_search(spark):
    rng = random.Random(3)
    snaps = [(wallet(rng) or "n", "base", rng.randrange(5000), "v5", float(i)) for i in range(900)]
    snaps = list({(a, t): s for s in snaps for a, t in [(s[0], s[2])]}.values())
    asks = [(i, wallet(rng) or "n", "base", rng.randrange(5200)) for i in range(900)]
    df = spark.createDataFrame(snaps, "address string, chain string, valid_at_ts long, feature_set_version string, completeness double")
    req = spark.createDataFrame(asks, "request_id long, address string, chain string, as_of_ts long")
    got = {r.request_id: (r.valid_at_ts, r.completeness) for r in labels.as_of_join(req, df, version="v5").collect()}
    for i, a, _, t in asks:
        before = [(s[2], s[4]) for s in snaps if s[0] == a and s[2] <= t]
        assert got[i] == (max(before) if before else (None, None))


def test_values_are_carried_over_partitions(spark):
    rng = random.Random(4)
    rows = [(wallet(rng), i, rng.choice([None, None, None, i * 10])) for i in range(800)] + [(HOT, 10_000 + i, None) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    out = prefix.carry_forward(df, ["k"], ["t"], "v", "last", partitions=16).collect()
    last, want = {}, {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        last[k] = v if v is not None else last.get(k)
        want[t] = last[k]
    assert {r.t: r.last for r in out} == want and len(out) == len(rows)
    most = df.repartitionByRange(16, "k", "t").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 400  # of 1,500 rows, nearly all of one key


def test_point_in_time_equals_a_scan_per_cutoff(spark):
    from datetime import datetime, timezone

    rng, base = random.Random(6), 1_650_000_000
    tx = [(wallet(rng) or "n", "base", rng.choice([None, base + rng.randrange(500 * DAY), base + rng.randrange(40) * 31 * DAY])) for _ in range(900)]
    lend = [(wallet(rng) or "n", "base", rng.choice(["aave", "compound"]), rng.choice(["borrow", "repay", "liquidation"]), base + rng.randrange(500 * DAY)) for _ in range(300)]
    held = [(wallet(rng) or "n", rng.choice(["ethereum", "base"]), rng.choice("pqr"), hex(rng.choice([0, 5, 10**6, 25 * 10**5])), base + rng.randrange(500) * DAY) for _ in range(400)]
    cuts = [(w, "base", base + rng.randrange(520 * DAY)) for w in (HOT, "a", "n", "nobody") for _ in range(6)] + [(HOT, "base", max(t for w, _, t in tx if w == HOT and t is not None)), (HOT, "base", None)]
    tokens = spark.createDataFrame([("p", "stable", 6, 1.0), ("q", "lido", 6, 2.0), ("x", "aave_v3", 0, 1.0)], "contract string, role string, decimals int, price double")
    out = features.point_in_time_features(
        spark.createDataFrame(tx, "address string, chain string, ts long"), spark.createDataFrame(lend, "address string, chain string, family string, kind string, ts long"), spark.createDataFrame(cuts + cuts[:3], "address string, chain string, cutoff long"),
        balances=spark.createDataFrame(held, "address string, chain string, contract string, balance_hex string, ts long"), tokens=tokens,
    ).collect()
    assert len(out) == len({c for c in cuts if c[2] is not None})
    utc = lambda t: datetime.fromtimestamp(t, timezone.utc)
    for r in out:
        ts = [t for w, _, t in tx if w == r.address and t is not None and t < r.cutoff]
        assert (r.tx_count, r.tx_count_30d, r.tx_count_90d, r.tx_count_180d) == (len(ts), *(sum(t >= r.cutoff - d * DAY for t in ts) for d in (30, 90, 180)))
        assert r.active_days_count == len({t // DAY for t in ts}) and r.active_months_12 == len({(utc(t).year, utc(t).month) for t in ts if t >= r.cutoff - 365 * DAY}), r
        assert r.wallet_age_days == ((r.cutoff - min(ts)) // DAY if ts else 0)
        own = [e for e in lend if e[0] == r.address and e[4] < r.cutoff]
        assert (r.aave_borrows, r.compound_repays, r.total_borrows, r.prior_liquidation_count) == (sum(e[2:4] == ("aave", "borrow") for e in own), sum(e[2:4] == ("compound", "repay") for e in own), sum(e[3] == "borrow" for e in own), sum(e[3] == "liquidation" for e in own))
        assert r.days_since_first_defi == ((r.cutoff - min(e[4] for e in own)) // DAY if own else 0)
        last = {}
        for h in sorted(h for h in held if h[0] == r.address and h[1] == r.chain and h[4] < r.cutoff):
            t, b = last.get(h[2], (-1, 0))
            last[h[2]] = max((t, b), (h[4], int(h[3], 16)))
        usd = {c: b / 1e6 * {"p": 1, "q": 2, "r": 0}[c] for c, (_, b) in last.items()}
        assert r.token_diversity == sum(b > 0 for _, b in last.values()) and r.total_portfolio_usd == pytest.approx(sum(usd.values())) and r.stablecoin_usd == pytest.approx(usd.get("p", 0)) and r.has_staked_eth == (last.get("q", (0, 0))[1] > 0)
