"""Cases that tell the reference's semantics from near misses, and jobs end to end."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge import sources
from tallyforge.functions import DAY
from tallyforge.operators import backtest, content, entity, features, labels, market, monitoring, scoring, training, usage, wallets
from tallyforge.plans import scratch
from tallyforge.plans.prefix import exact_quantiles, running_sums

NOW = 1_700_000_000
TX = "address string, chain string, hash string, ts long, from_addr string, to_addr string"
LEND = "address string, chain string, family string, kind string, ts long, block long"


# Plans


def test_exact_quantiles_equal_a_sort(spark):
    rng = random.Random(4)
    x = [rng.choice([1.5, 2.0, rng.random() * 10]) for _ in range(997)] + [None]
    got = exact_quantiles(spark.createDataFrame([(v,) for v in x], "x double").repartition(7), "x", [0, 0.3, 0.5, 0.99, 1])
    assert got == pytest.approx(np.quantile([v for v in x if v is not None], [0, 0.3, 0.5, 0.99, 1]).tolist())
    assert exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]


def test_running_sums_in_the_order_of_two_columns(spark):
    rows = [("k", t, i, 1) for i, t in enumerate([5, 3, 5, 1, 3])] * 1
    got = {(r.t, r.i): r.before_n for r in running_sums(spark.createDataFrame(rows, "k string, t int, i int, n int"), ["k"], ["t", "i"], ["n"]).collect()}
    assert got == {(1, 3): 0, (3, 1): 1, (3, 4): 2, (5, 0): 3, (5, 2): 4}


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: "spark://host:7077" if key == "spark.master" else default)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Session)


def test_scratch_tables_of_a_scope_are_dropped(spark):
    import os

    with scratch.scratch_scope() as made:
        first = scratch.materialise(spark.range(5), "one")
        second = scratch.materialise(first.where("id > 2"), "two")
    assert len(made) == 2 and all(os.path.isdir(p.removeprefix("file:")) for p in made)
    scratch.drop_scratch(spark, made[:1])
    assert not os.path.exists(made[0].removeprefix("file:")) and second.count() == 2
    assert scratch.scratch_path(spark, "x") not in made


# Features


def test_a_repay_lists_a_protocol_and_does_not_count_it(spark):
    base = "address string, chain string, has_aave boolean, has_compound boolean, aave_borrows int, aave_repays int, compound_borrows int, compound_repays int, has_uniswap_lp boolean, has_staked_eth boolean"
    rows = [("a", "base", False, False, 0, 1, 0, 0, False, True), ("b", "ethereum", False, True, 2, 0, 0, 0, True, True)]
    got = {r.address: (r.protocols_used, r.protocols_used_count) for r in features.protocols_used(spark.createDataFrame(rows, base)).collect()}
    assert got == {"a": (["Aave", "Lido (wstETH)"], 1), "b": (["Aave", "Compound", "Uniswap", "Lido"], 4)}


def test_balances_are_decoded_once_a_row(spark):
    cases = {"0x0": 0.0, "0x": 0.0, "0xff": 255.0, "0x" + "0" * 60 + "1234": 0x1234, "0xfffffffffffffff": float(0xFFFFFFFFFFFFFFF), "0x10000000000000000": 2.0**64, "0x" + "f" * 64: 2.0**256, "xyz": None, None: None, "0XAB": 171.0, "0x" + "1" * 65: None}
    df = spark.createDataFrame([(k,) for k in cases], "h string").withColumn("v", features.hex_to_double("h"))
    assert {r.h: r.v for r in df.collect()} == {k: v if v is None else pytest.approx(v) for k, v in cases.items()}
    plan = df.where("v > 0").withColumn("w", F.col("v") * 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("conv(") <= 2 * 9  # one short form and eight parts, in the filter and the projection at most


def test_portfolio_counts_contracts_once(spark):
    rows = [("a", "ethereum", "usd", "0xf4240"), ("a", "ethereum", "usd", "0xf4240"), ("a", "ethereum", "usd", "0x1e8480"), ("a", "ethereum", "old", "0x1"), ("a", "ethereum", "none", "0x0"), ("b", "base", "old", "0x5"), ("c", "base", "none", "0x0")]
    tokens = spark.createDataFrame([("usd", "stable", 6, 1.0), ("old", "aave_v2", 6, 0.0)], "contract string, role string, decimals int, price double")
    got = {r.address: (r.token_diversity, r.stablecoin_usd, r.has_aave) for r in features.portfolio_features(spark.createDataFrame(rows, "address string, chain string, contract string, balance_hex string"), tokens).collect()}
    assert got == {"a": (2, 4.0, True), "b": (1, 0.0, False)}


def test_points_in_time_see_nothing_from_the_cutoff_on(spark):
    t = spark.createDataFrame([("w", "c", f"h{i}", ts, "w", "x") for i, ts in enumerate([NOW - 200 * DAY, NOW - 100 * DAY, NOW - 1, NOW, NOW + 5])], TX)
    e = spark.createDataFrame([("w", "c", "aave", "borrow", NOW - 10 * DAY, None), ("w", "c", "compound", "repay", NOW - 1, None), ("w", "c", "aave", "liquidation", NOW, None)], LEND)
    b = spark.createDataFrame([("w", "c", "usd", "0x1", NOW - 50), ("w", "c", "usd", "0xf4240", NOW - 5), ("w", "c", "usd", "0x0", NOW)], "address string, chain string, contract string, balance_hex string, ts long")
    tokens = spark.createDataFrame([("usd", "stable", 6, 1.0)], "contract string, role string, decimals int, price double")
    cut = spark.createDataFrame([("w", "c", NOW), ("w", "c", NOW + 100), ("v", "c", NOW)], "address string, chain string, cutoff long")
    got = {(r.address, r.cutoff): r for r in features.point_in_time_features(t, e, cut, balances=b, tokens=tokens).collect()}
    r = got["w", NOW]
    assert (r.tx_count, r.tx_count_30d, r.tx_count_90d, r.tx_count_180d, r.active_days_count, r.wallet_age_days) == (3, 1, 1, 2, 3, 200)
    assert (r.aave_borrows, r.compound_repays, r.total_borrows, r.total_repays, r.prior_liquidation_count, r.days_since_first_defi, r.stablecoin_usd) == (1, 1, 1, 1, 0, 10, 1.0)
    assert got["w", NOW + 100].prior_liquidation_count == 1 and got["w", NOW + 100].token_diversity == 0 and got["v", NOW].tx_count == 0


def test_no_cap_on_histories_by_default(spark):
    t = spark.createDataFrame([("w", "c", f"h{i}", NOW + i, "w", "x") for i in range(30)], TX)
    assert features.merge_transfers(t, t.limit(0)).count() == 30 and features.merge_transfers(t, t.limit(0), limit=5).count() == 5


def test_rows_with_gaps_are_dropped(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "a"), (3, float("nan"), "a"), (4, 2.0, None)], "id int, x double, s string")
    assert [r.id for r in labels.drop_missing(df, ["x", "s"]).collect()] == [1]
    assert sorted(r.x for r in labels.clip_quantile(df.where("id in (1, 4)"), ["x"], q=0.5).collect()) == [1.0, 1.5]


# Market, usage, content


def listings(spark, rows):
    names = "listing_id int, lender string, amount double, currency string, listing_chain string, min_apr double, max_apr double, duration_days int, min_score int, collateral_pct double, lender_score int, status string, created long, expires long"
    return spark.createDataFrame(rows, names)


def test_listing_filters_and_sorts(spark):
    rows = [(1, "a", 100.0, "ETH", "EVM", 5.0, 9.0, 30, 500, 10.0, 700, "OPEN", 1, 10), (2, "b", 200.0, "ETH", "EVM", 4.0, 20.0, 60, 500, 10.0, 800, "OPEN", 2, 10), (3, "b", 300.0, "DAI", "SOLANA", 3.0, 8.0, 90, 500, 10.0, 600, "OPEN", 3, 10), (4, "b", 9.0, "ETH", "EVM", 1.0, 2.0, 9, 500, 10.0, 600, "OPEN", 3, 5), (5, "b", 9.0, "ETH", "EVM", 1.0, 2.0, 9, 500, 10.0, 600, "MATCHED", 3, 50)]
    lenders = spark.createDataFrame([("a", 710), ("b", 640)], "address string, score int")
    ids = lambda **k: [r.listing_id for r in market.search_listings(listings(spark, rows), lenders, now=5, **k).orderBy("pos").collect()]
    assert ids() == [3, 2, 1] == ids(sort="nonsense") and ids(max_apr=9) == [3, 1] and ids(min_apr=4) == [2, 1] and ids(currency="ETH") == [2, 1] and ids(chain="SOLANA") == [3]
    assert ids(min_duration=31, max_duration=60) == [2] and ids(min_lender_score=700, sort="highest_lender_score") == [2, 1] and ids(sort="lowest_apr") == [3, 2, 1] and ids(sort="amount") == [3, 2, 1] and ids(page=2) == []


def test_loans_use_the_score_when_applying_and_hold_collateral(spark):
    apps = spark.createDataFrame([(1, 1, "x", 200.0, 850, "ACCEPTED", 9), (2, 1, "y", 50.0, 500, "ACCEPTED", 8), (3, 1, "z", 50.0, 500, "PENDING", 1)], "application_id int, listing_id int, borrower string, amount double, borrower_score int, status string, created long")
    r = market.originate_loans(apps, listings(spark, [(1, "a", 100.0, "ETH", "EVM", 5.0, 9.0, 30, 500, 40.0, 700, "OPEN", 1, 10)])).collect()
    assert [(x.application_id, x.apr, x.collateral, x.fee, x.due) for x in r] == [(2, 9.0, 20.0, pytest.approx(0.375), 8 + 30 * DAY)]


def test_lender_rules_in_order(spark):
    ok = (1, "a", 100.0, "ETH", "EVM", 5.0, 9.0, 30, 500, 10.0, 700, "OPEN", 1, 10)
    change = lambda i, **k: tuple(k.get(n, v) for n, v in zip("listing_id lender amount currency listing_chain min_apr max_apr duration_days min_score collateral_pct lender_score status created expires".split(), (i, *ok[1:]), strict=True))
    rows = [change(1), change(2, amount=0.0), change(3, currency="E"), change(4, max_apr=1001.0), change(5, duration_days=0), change(6, min_score=299), change(7, collateral_pct=-1.0), change(8, max_apr=4.0), change(9, expires=5), change(10, lender="none"), change(11, lender="low"), change(12, amount=2e9, expires=1)]
    w = spark.createDataFrame([("a", 500), ("low", 499)], "address string, score int")
    got = {r.listing_id: r.reason for r in market.lender_eligibility(listings(spark, rows), w, now=5).collect()}
    assert got == dict(enumerate(["ok", "amount", "currency", "apr range", "duration", "borrower score", "collateral", "apr bounds", "expiry", "wallet not scored", "score too low", "amount"], 1))


def test_digest_spends_only_spend_items(spark):
    runs = spark.createDataFrame([("a", "OK", NOW - DAY, 1.0), ("a", "OK", NOW - DAY - 1, 1.0)], "agent string, status string, ts long, cost double")
    out = spark.createDataFrame([("SPEND", "EXECUTED", NOW - DAY, 5.0), ("POST", "EXECUTED", NOW, 7.0), ("SPEND", "EXECUTED", NOW - DAY - 1, 9.0), ("POST", "PENDING", 1, 0.0)], "kind string, status string, ts long, amount double")
    r = usage.ops_digest(runs, out, now=NOW).collect()
    assert [(x.n, x.pending, x.spend) for x in r] == [(1, 1, 5.0)]


def test_requests_of_any_status_and_unknown_cache_state(spark):
    log = spark.createDataFrame([(10, 1.0, 200, True), (12, 3.0, 200, False), (14, 5.0, 503, None), (20, 9.0, 0, None)], "ts long, latency_ms double, status int, cached boolean")
    r = monitoring.request_summary(log, wall_seconds=2).first()
    assert (r.n, r.p50_ms, r.max_ms, r.per_second, r.statuses, r.n_cached, r.n_uncached, r.n_unknown) == (4, 4.0, 9.0, 2.0, {0: 1, 200: 2, 503: 1}, 1, 1, 2)


def test_claims_equal_a_plain_check(spark):
    rng = random.Random(5)
    facts = [(254729.0, "count", True), (0.8815, "ratio", True), (25000.0, "count", True), (77.0, "count", False), (0.0909, "ratio", True), (None, "count", True)]
    texts = [f"{rng.choice(['250K', '254,729', '88', '88.2', '0.8815', '25K', '20K', '9', '9.1', '77', '300M', '254729.0'])}{rng.choice(['', '+', '%', ' percent'])}" for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = content.numeric_claims(docs)

    def backed(raw, value, bound, percent):
        decimals = len("".join(c for c in (raw.split(".") + [""])[1] if c.isdigit()))
        for v, unit, ok in facts:
            if not ok or v is None:
                continue
            for x in [v] + ([v * 100] if percent and unit == "ratio" else []):
                if bound:
                    digits = len(str(round(value)).rstrip("0")) or 1
                    grain = 10 ** (len(str(round(value))) - digits)
                    if value > 0 and x >= value and x // grain * grain == value:
                        return True
                elif abs(x - value) <= (10**-decimals if decimals else 0.5):
                    return True
        return False

    want = sorted(r.doc_id for r in found.collect() if not backed(r.raw, r.magnitude, r.is_bound, r.is_percent))
    got = sorted(r.doc_id for r in content.claim_violations(found, spark.createDataFrame(facts, "value double, unit string, verified boolean")).collect())
    assert got == want and 0 < len(want) < 120


def test_posts_beyond_the_cap_of_a_day_wait(spark):
    rows = [(i, "seo", NOW // DAY * DAY + i % 2 * DAY + i, "text") for i in range(16)] + [(90, "email", NOW, "no token"), (91, "email", NOW, "{{unsubscribe_url}}"), (92, "email", NOW, "{{unsubscribe_url}}")]
    x = spark.createDataFrame(rows, "doc_id int, channel string, posted long, text string")
    none = spark.createDataFrame([(2,)], "doc_id int")
    got = {r.doc_id: r.decision for r in content.publish_decision(x, none, none.limit(0)).collect()}
    assert got[2] == got[90] == "BLOCKED" and (got[91], got[92]) == ("ready", "deferred")
    assert [i for i in range(16) if got[i] == "ready"] == [0, 1, 3, 4, 5, 6, 7, 8]


# Entities


def test_members_active_later_weigh_as_if_active_now(spark):
    rows = [("e", 800, 10, NOW + 400 * DAY), ("e", 400, 10, NOW), ("one", 612, 0, 0)]
    got = {r.entity_id: r.score for r in entity.entity_scores(spark.createDataFrame(rows, "entity_id string, score int, activity int, last_active_ts long"), now=NOW).collect()}
    assert got == {"e": 600, "one": 612}


def test_cospend_among_given_pairs(spark):
    times = spark.createDataFrame([(a, t) for a in "abc" for t in (0, 1000, 2000)], "address string, ts long")
    among = spark.createDataFrame([("a", "c")], "a string, b string")
    assert [(r.a, r.b, r.conf) for r in entity.temporal_cospend_pairs(times, among=among).collect()] == [("a", "c", 1.0)]
    assert entity.temporal_cospend_pairs(times).count() == 3


# Backtest, training, scoring end to end


def test_a_backtest_refuses_the_future_and_writes_its_report(spark, tmp_path):
    rng = random.Random(2)
    rows = [(100, 100, 100, rng.random(), 500 + i % 200, i % 3 == 0 and 1 or 0, "base", i % 400, i % 7) for i in range(60)]
    names = "as_of_ts long, features_valid_at_ts long, outcome_start_ts long, p double, score int, label int, chain string, age int, borrows int"
    df = spark.createDataFrame(rows, names)
    doc = backtest.report(backtest.run_backtest(df, model_version="v"))
    assert doc["n_rows"] == 60 and doc["positives"] == 20 and doc["model_version"] == "v" and set(doc["metrics"]) == {"roc_auc", "pr_auc", "brier", "ece"} and len(doc["reliability"]) == 10 and doc["slices"]["chain:base"]["n"] == 60
    backtest.write_report(spark, doc, str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report")).first()[0])["metrics"] == doc["metrics"]
    with pytest.raises(ValueError, match="look ahead"):
        backtest.run_backtest(df.withColumn("features_valid_at_ts", F.lit(101)))
    with pytest.raises(ValueError, match="at least one row"):
        backtest.run_backtest(df.limit(0))
    scored = backtest.run_backtest(df.drop("score"), lambda x: x.withColumn("score", F.lit(500)), target=None)
    assert scored["operating_point"].first().recall == 1.0


def test_training_ranks_features_and_holds_rows_out(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = (x[:, 2] + 0.3 * rng.normal(size=600) > 0).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "vec_id int, features array<double>, label int")
    held = F.col("vec_id") % 4 == 0
    gbt, base = training.train(df.withColumn("held", held), trees=8, depth=2, held="held")
    assert training.importances(gbt, list("abcd"))[0][0] == "c"
    r = training.training_report(gbt, df.where(held)).first()
    assert r.tp + r.fp + r.fn + r.tn == 150 and r.accuracy > 0.85 and r.roc_auc > 0.9
    assert all(a > 0.85 for a in training.fold_auc(df, folds=3, trees=3))
    p = training.predictions(base, df)
    slope, intercept = training.fit_platt(p.withColumn("weight", F.lit(1.0)))
    assert slope > 0 and abs(intercept) < 2
    grid, fitted = training.fit_calibration(p.withColumn("weight", F.lit(1.0)), step=0.1)
    assert fitted == sorted(fitted) and len(grid) == 11


def test_wallets_end_to_end(spark):
    t = spark.createDataFrame([("w1", "ethereum", "h1", NOW - 300 * DAY, "w1", "x"), ("w2", "ethereum", "h2", NOW - 3 * DAY, "w2", "y"), ("w4", "ethereum", "h3", NOW - 9 * DAY, "w4", "y")], TX)
    e = spark.createDataFrame([("w1", "ethereum", "aave", "borrow", NOW - 200 * DAY, 1), ("w1", "ethereum", "aave", "repay", NOW - 200 * DAY + 30, 2), ("w4", "ethereum", "compound", "borrow", NOW - 8 * DAY, 5)], LEND)
    w = spark.createDataFrame([(f"w{i}", "ethereum") for i in (1, 2, 3, 4)], "address string, chain string")
    bad = spark.createDataFrame([("w4", "ethereum", {k: "down" for k in ("etherscan", "alchemy", "aave", "compound")}), ("w1", "ethereum", {"uniswap": "down"})], "address string, chain string, errors map<string,string>")
    good = spark.createDataFrame([("w4", "ethereum", 701, "B", 66, 0.9, 0.04), ("w1", "ethereum", 1, "F", 1, 1.0, 0.5)], "address string, chain string, score long, grade string, percentile long, completeness double, calibrated_pd double")
    model = scoring.Ensemble((scoring.Tree((1, -1, -1), (2, -1, -1), (10, 0, 0), (0.5, 0, 0), (True, True, True), (0.0, 1.0, -1.0)),))
    got = {r.address: r for r in wallets.score_wallets(w, t, e, model, as_of=NOW, calibration=([0.0, 0.5, 1.0], [0.0, 0.25, 1.0]), errors=bad, known_good=good, model_version="m").collect()}
    raw = 1 / (1 + np.exp(1.0))
    assert got["w1"].calibrated_pd == pytest.approx(raw / 2) and got["w1"].penalty == pytest.approx(0.5) and got["w1"].score == max(300, got["w1"].model_score - 125) and got["w1"].flagged and [s.id for s in got["w1"].signals] == ["instant_repay"]
    assert (got["w2"].score, got["w2"].grade, got["w2"].no_borrow_history, got["w2"].penalty) == (0, "F", True, 0.0)
    assert (got["w3"].score, got["w3"].new_wallet, got["w3"].completeness, got["w3"].protocols_used) == (300, True, 1.0, [])
    assert (got["w4"].score, got["w4"].grade, got["w4"].percentile, got["w4"].last_known_good, got["w4"].completeness, got["w4"].calibrated_pd) == (701, "B", 66, True, 0.9, 0.04)
    assert got["w4"].factors is None and got["w4"].model_version is None  # the earlier envelope stands whole, with what it has not
    for w in ("w2", "w3"):  # no model has scored a gated wallet
        assert (got[w].factors, got[w].top_contributions, got[w].weakest, got[w].calibrated_pd, got[w].model_version) == ([], [], [], None, "unknown")
    assert got["w1"].degraded_sources == ["uniswap"] and [f.limited_data for f in got["w1"].factors] == [False, False, True, False] and got["w1"].model_version == "m"


# Sources


def test_interchange_files_round_trip(spark, tmp_path):
    rows = [("w", "base", 1, 1, 2, [float(i) for i in range(34)], 1, 3.0, 2.0), ("v", "base", 1, 1, 2, [0.5] * 34, 0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "address string, chain string, as_of_ts long, features_valid_at_ts long, outcome_start_ts long, features array<double>, label int, wallet_age_days double, total_borrows double")
    path = str(tmp_path / "holdout.jsonl")
    sources.write_holdout(df, path, feature_names=features.FEATURES, exported_at="2024-01-01T00:00:00Z")
    assert sorted(map(tuple, sources.holdout_rows(spark, path).select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    whole = tmp_path / "one.json"
    whole.write_text(json.dumps({"exportedAt": "x", "featureNames": list(features.FEATURES), "rows": [{"address": "w", "chain": "base", "as_of_ts": 1, "features": [1.0], "label": 1}]}, indent=1))
    assert sources.holdout_rows(spark, str(whole)).first().features == [1.0]
    csv = str(tmp_path / "features")
    sources.write_features_csv(df.select("address", "chain", "label", "features"), csv, names=features.FEATURES)
    back = sources.read_features_csv(spark, csv, names=features.FEATURES)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.select("address", "chain", "label", "features").collect()))
