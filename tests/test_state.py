"""Rescoring by stored state: equal to a full rescore after every batch, whatever is repeated, and reading touched wallets alone."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import integrity, scoring, wallets
from tallyforge.streaming.state import WalletState

TX = "address string, chain string, hash string, ts long, from_addr string, to_addr string"
LEND = "address string, chain string, family string, kind string, ts long, block long"
NOW, DAY = 1_700_000_000, 86400
MODEL = scoring.Ensemble((scoring.Tree((1, -1, -1), (2, -1, -1), (4, 0, 0), (5.0, 0, 0), (True, True, True), (0.0, 0.4, -0.3)), scoring.Tree((1, -1, -1), (2, -1, -1), (16, 0, 0), (1.5, 0, 0), (True, True, True), (0.0, 0.1, -0.6))))


def some(rng, batch, wallets_of_batch):
    tx, lend = [], []
    for i in range(60):
        w, other = rng.choice(wallets_of_batch), rng.choice(["x", "y", "z", "w1", ""])
        ts = rng.choice([None, NOW - rng.randrange(200) * DAY, NOW - rng.randrange(3000)])
        tx.append((w, "base", f"h{batch}-{i}", ts, *((w, other) if rng.random() < 0.6 else (other, w))))
        if rng.random() < 0.4:
            lend.append((w, "base", rng.choice(["aave", "compound"]), rng.choice(["borrow", "repay", "liquidation"]), NOW - rng.randrange(4000), rng.choice([None, rng.randrange(300)])))
    return tx, lend


def told(df):
    return {r.address: (r.score, r.model_score, round(r.penalty, 9), sorted((s.id, round(s.severity, 9)) for s in r.signals), r.protocols_used) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_a_full_rescore_after_each_batch(spark, tmp_path, seed):
    rng, state = random.Random(seed), WalletState(spark, str(tmp_path / "s"), partitions=4)
    all_tx, all_lend = [], []
    for batch in range(3):
        tx, lend = some(rng, batch, rng.sample([f"w{i}" for i in range(8)], 4))
        all_tx, all_lend = all_tx + tx, all_lend + lend
        t, e = spark.createDataFrame(tx, TX), spark.createDataFrame(lend, LEND)
        for _ in range(1 + (batch == 1)):  # a batch that is repeated is not added twice
            state.take(t, e, batch)
        touched = t.select("address", "chain").distinct()
        full = wallets.score_wallets(touched, spark.createDataFrame(all_tx, TX), spark.createDataFrame(all_lend, LEND), MODEL, as_of=NOW)
        got = told(state.rescore(touched, MODEL, as_of=NOW))
        assert got == told(full) and len(got) <= 4
    sizes = integrity.funder_sizes(integrity.first_funders(spark.createDataFrame(all_tx, TX)))
    assert sorted(map(tuple, state.sizes.read().collect())) == sorted(map(tuple, sizes.collect()))


def test_a_lost_batch_is_completed(spark, tmp_path):
    rng = random.Random(4)
    tx, lend = some(rng, 0, ["w1", "w2", "w3"])
    t, e = spark.createDataFrame(tx, TX), spark.createDataFrame(lend, LEND)
    state = WalletState(spark, str(tmp_path / "s"), partitions=4)
    for lost in ("pairs", "lending", "funders", "sizes"):
        store, merge = getattr(state, lost), getattr(state, lost).merge
        store.merge = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
        with pytest.raises(RuntimeError):
            state.take(t, e, 0)
        store.merge = merge
    state.take(t, e, 0)
    touched = t.select("address", "chain").distinct()
    assert told(state.rescore(touched, MODEL, as_of=NOW)) == told(wallets.score_wallets(touched, t, e, MODEL, as_of=NOW))


def test_only_touched_wallets_are_read(spark, tmp_path):
    rng = random.Random(5)
    tx, lend = some(rng, 0, [f"w{i}" for i in range(30)])
    state = WalletState(spark, str(tmp_path / "s"), partitions=16)
    state.take(spark.createDataFrame(tx, TX), spark.createDataFrame(lend, LEND), 0)
    touched = spark.createDataFrame([("w1", "base")], "address string, chain string")
    found = state.evidence(touched)
    for df in (found.ticks, found.pairs, found.lending):
        assert len({p for f in df.inputFiles() for p in f.split("/") if p.startswith("part=")}) == 1 and {r.address for r in df.collect()} <= {"w1"}
    plan = integrity.detect_evidence(found)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):  # every scan of the state by wallet lies below a semi-join that no aggregate is under
        if "Relation" in line and "parquet" in line and re.search(r"\bn#", line):
            above, at = [], depth(line)
            for up in reversed(lines[:i]):
                if depth(up) < at:
                    at = depth(up)
                    above.append(up)
            first = next(k for k, up in enumerate(above) if "Aggregate" in up or "LeftSemi" in up)
            assert "LeftSemi" in above[first], above[:4]


def test_wallets_of_no_evidence(spark, tmp_path):
    state = WalletState(spark, str(tmp_path / "s"), partitions=4)
    touched = spark.createDataFrame([("w1", "base")], "address string, chain string")
    assert told(state.rescore(touched, MODEL, as_of=NOW)) == {"w1": (300, 300, 0.0, [], [])}
    state.take(spark.createDataFrame([], TX), spark.createDataFrame([], LEND), 0)
    assert state.ticks.version().batches == {"activity": 0} and state.rescore(touched.limit(0), MODEL, as_of=NOW).count() == 0


def test_evidence_gives_what_histories_give(spark):
    tx, lend = some(random.Random(7), 0, ["w1", "w2", "w3", "w4"])
    t, e = spark.createDataFrame(tx + tx[:20], TX), spark.createDataFrame(lend + lend[:9], LEND)
    signal = lambda df: sorted((r.address, round(r.severity, 9)) for r in df.collect())
    assert signal(integrity.instant_repay(e)) == signal(integrity.instant_repay(integrity.lending_evidence(e), copies="n"))
    cohort = spark.createDataFrame([("w1", "base", 4)], "address string, chain string, cohort long")
    got = {r.address: r.sybil_funding for r in integrity.detect(t, e, cohort=cohort).collect()}
    assert got["w1"] == pytest.approx(0.4) and all(got[w] == 0 for w in got if w != "w1")
