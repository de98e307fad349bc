"""Hand-computed cases of the scoring operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import DAY, round_half_up
from tallyforge.operators import backtest, content, entity, features, integrity, labels, market, monitoring, scoring, training, usage
from tallyforge.plans.graph import connected_components
from tallyforge.plans.prefix import running_sums
from tallyforge.plans.skew import explode_copies, lookup, rank_within

TX = "address string, chain string, hash string, ts long, from_addr string, to_addr string"
LEND = "address string, chain string, family string, kind string, ts long, block long"
AS_OF = 1_700_000_000


def one(df, col=None):
    r = df.collect()
    assert len(r) == 1
    return r[0][col] if col else r[0]


def txs(spark, rows):
    return spark.createDataFrame([("me", "ethereum", f"h{i}", *r) for i, r in enumerate(rows)], TX)


# Plans


def test_round_half_up_on_negatives(spark):
    assert [r[0] for r in spark.createDataFrame([(2.5,), (-2.5,), (-0.4,)], "x double").select(round_half_up(F.col("x"))).collect()] == [3, -2, 0]


def test_running_sums_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(k, float(i), rng.randrange(9)) for k in "ab" for i in range(500)]
    got = {(r.k, r.p): r.before_v for r in running_sums(spark.createDataFrame(rows, "k string, p double, v long"), ["k"], "p", ["v"], partitions=7).collect()}
    for k in "ab":
        total = 0
        for kk, p, v in sorted(rows):
            if kk == k:
                assert got[k, p] == total
                total += v


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None), (7, 7)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: root(x) for x in up}


def test_lookup_and_rank_with_a_hot_key(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 400)) AS k")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = lookup(rows, groups, ["k"], "n", 3000, parts=16).collect()
    want = {r.k: (r.n, r.top) for r in groups.collect()}
    assert len(got) == 3000 and all((r.n, r.top) == want[r.k] for r in got)
    copies = spark.createDataFrame([("g", 1, 3), ("g", 2, 1), ("h", 1, 2)], "g string, x int, c long")
    each = explode_copies(rank_within(copies, "g", ["x"], "first", copies="c", spread=4), "c", "i").selectExpr("g", "first + i AS place").collect()
    assert sorted(each) == [("g", 0), ("g", 1), ("g", 2), ("g", 3), ("h", 0), ("h", 1)]


# Features


def test_activity_counts_unknown_times_and_boundaries(spark):
    t = txs(spark, [(AS_OF - 30 * DAY, "me", "x"), (AS_OF - 30 * DAY - 1, "me", "x"), (None, "me", None), (AS_OF - 400 * DAY, "x", "me")])
    r = one(features.activity_features(t, as_of=AS_OF))
    assert (r.tx_count, r.tx_count_30d, r.tx_count_90d, r.active_months_12) == (4, 1, 2, 1)


def test_completeness_and_degraded_sources(spark):
    df = spark.createDataFrame([({"etherscan": "x"},), ({},), ({"aave": "e", "compound": "e"},), (None,)], "errors map<string,string>")
    rows = features.completeness(df).collect()
    assert [r.completeness for r in rows] == [0.6, 1.0, 0.7, 1.0] and rows[2].degraded_sources == ["aave", "compound"]


def test_hexadecimal_of_256_bits(spark):
    values = ["0x" + "f" * 64, "0xde0b6b3a7640000", "0x", "0xzz", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "h string").select(features.hex_to_double("h")).collect()]
    assert got == [pytest.approx(2.0**256), 1e18, 0.0, None, None]


def test_merge_keeps_sent_side_and_caps(spark):
    sent = spark.createDataFrame([("a", "c", "h1", 5, "s"), ("a", "c", "h2", None, "s")], "address string, chain string, hash string, ts long, side string")
    got = spark.createDataFrame([("a", "c", "h1", 5, "r"), ("a", "c", "h3", 9, "r"), ("a", "c", "h4", 1, "r")], sent.schema)
    assert [(r.hash, r.side) for r in features.merge_transfers(sent, got, limit=2).orderBy("ts").collect()] == [("h1", "s"), ("h3", "r")]


def test_feature_vector_refuses_other_names(spark):
    with pytest.raises(ValueError, match="missing"):
        features.feature_vector(spark.createDataFrame([(1,)], "tx_count int"))


# Labels


def test_as_of_join_never_sees_the_future(spark):
    snaps = spark.createDataFrame([("a", "c", t, v, float(t)) for t in (10, 20) for v in ("v1", "v2")] + [("b", "c", 5, "v1", 5.0)], "address string, chain string, valid_at_ts long, feature_set_version string, completeness double")
    req = spark.createDataFrame([(1, "a", "c", 9), (2, "a", "c", 10), (3, "a", "c", 19), (4, "a", "c", 99), (5, "z", "c", 99)], "request_id int, address string, chain string, as_of_ts long")
    got = {r.request_id: r.completeness for r in labels.as_of_join(req, snaps, version="v1").collect()}
    assert got == {1: None, 2: 10.0, 3: 10.0, 4: 20.0, 5: None}


def test_window_labels_closed_end(spark):
    e = spark.createDataFrame([("a", "c", "f", "borrow", 5, 0), ("a", "c", "f", "liquidation", 20, 0), ("b", "c", "f", "borrow", 5, 0), ("d", "c", "f", "borrow", 10, 0)], LEND)
    assert {r.address: r.label for r in labels.window_labels(e, cutoff=10, end=20).collect()} == {"a": 1, "b": 0}
    assert {r.address: r.label for r in labels.window_labels(e, cutoff=10, end=20, closed=False).collect()} == {"a": 0, "b": 0}


def test_lookahead_gate_raises(spark):
    rows = spark.createDataFrame([(10, 10, 10), (10, 11, 12)], "as_of_ts long, features_valid_at_ts long, outcome_start_ts long")
    with pytest.raises(ValueError, match="1 rows"):
        labels.lookahead_gate(rows, mode="raise")


# Scoring


def test_tree_margin_is_base_plus_contributions(spark):
    tree = scoring.Tree((1, -1, -1), (2, -1, -1), (3, 0, 0), (0.5, 0, 0), (False, True, True), (0.1, -1.0, 2.0))
    model = scoring.Ensemble((tree, tree), base_score=0.2)
    rows = [[0.0] * 34 for _ in range(4)]
    rows[1][3], rows[2][3], rows[3][3] = 0.5, None, float("nan")
    df = spark.createDataFrame([(r,) for r in rows], "features array<double>")
    got = scoring.score_trees(df, model).collect()
    base = math.log(0.2 / 0.8) + 0.2
    assert [r.margin for r in got] == pytest.approx([base - 2.2, base + 3.8, base + 3.8, base + 3.8])
    assert all(base + sum(r.contributions) == pytest.approx(r.margin) for r in got)


def test_trees_equal_a_walk(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 34))
    x[rng.random(x.shape) < 0.1] = np.nan
    tree = scoring.Tree((1, 3, 5, -1, -1, -1, -1), (2, 4, 6, -1, -1, -1, -1), (1, 2, 3, 0, 0, 0, 0), (0.1, -0.2, 0.3, 0, 0, 0, 0), (True, False, True, True, True, True, True), tuple(rng.normal(size=7)))
    margin, parts = scoring.Ensemble((tree,)).score(x)
    for row, m, p in zip(x, margin, parts, strict=True):
        node = 0
        while tree.left[node] >= 0:
            v = row[tree.feature[node]]
            node = tree.left[node] if (tree.default_left[node] if np.isnan(v) else v < tree.threshold[node]) else tree.right[node]
        assert m == pytest.approx(tree.weight[node]) and tree.weight[0] + p.sum() == pytest.approx(m)


def test_scores_grades_and_percentiles(spark):
    df = spark.createDataFrame([(1e-9, 300), (0.0030399445514193084, 350), (0.1865083873271942, 578), (1.0, 850)], "p double, s int")
    got = df.select(scoring.pd_to_score(F.col("p")).alias("x"), scoring.grade(F.col("s")).alias("g"), scoring.score_percentile(F.col("s")).alias("q")).collect()
    assert [r.x for r in got] == [850, 800, 350, 300] and [r.g for r in got] == ["F", "F", "C", "A"] and [r.q for r in got] == [1, 10, 40, 100]


def test_calibration_is_clamped_and_linear(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.25,), (0.75,), (2.0,)], "p double")
    assert [r[0] for r in df.select(scoring.calibrate(F.col("p"), [0.0, 0.5, 1.0], [0.1, 0.2, 0.6])).collect()] == pytest.approx([0.1, 0.1, 0.15, 0.4, 0.6])


def test_top_contributions_merge_equal_labels(spark):
    c = [0.0] * 34
    c[0], c[1], c[5], c[9], c[10] = 0.2, -0.5, 0.3, -0.1, 0.4
    got = one(scoring.top_contributions(spark.createDataFrame([(c,)], "contributions array<double>"), k=1))
    assert [(t.label, round(t.impact, 6)) for t in got.top_contributions] == [("Wallet age", 0.5), ("Aave repayments", -0.4)]


def test_band_through_anchors_reproduces_the_published_one():
    band = training.fit_band(0.0030399445514193084, 0.1865083873271942)
    assert band["factor"] == pytest.approx(scoring.BAND["factor"]) and band["offset"] == pytest.approx(scoring.BAND["offset"])


def test_solana_gates(spark):
    cols = "first_ts long, tx_count long, active_months_12 long, sol_balance double, token_count long, borrow_count long, repay_count long, " + ", ".join(f"has_{x} boolean" for x in ("msol", "jitosol", "bsol", "jupiter", "kamino", "solend", "marginfi", "marinade"))
    flags = [True] * 8
    df = spark.createDataFrame([(None, 0, 0, 0.0, 0, 0, 0, *flags), (AS_OF - 730 * DAY, 500, 10, 10.0, 10, 0, 0, *flags), (AS_OF - 730 * DAY, 500, 10, 10.0, 10, 1, 1, *flags)], cols)
    assert [(r.score, r.grade, r.percentile) for r in scoring.score_solana(df, as_of=AS_OF).collect()] == [(300, "F", 1), (0, "F", 0), (850, "A", 90)]


# Backtest


def ranked(spark, rows):
    return one(backtest.ranking(spark.createDataFrame(rows, "p double, label int, weight double")))


def test_ranking_metrics(spark):
    assert ranked(spark, [(0.9, 1, 1.0), (0.8, 0, 1.0), (0.7, 1, 1.0), (0.1, 0, 1.0)]) == pytest.approx((0.75, 5 / 6))
    assert ranked(spark, [(0.5, 1, 1.0), (0.5, 0, 1.0)]) == pytest.approx((0.5, 0.5))
    assert ranked(spark, [(0.5, 0, 1.0), (0.6, 0, 1.0)]) == (0.5, 0.0)
    assert ranked(spark, [(0.9, 1, 2.0), (0.5, 0, 1.0), (0.4, 1, 1.0)])[0] == pytest.approx(2 / 3)


def test_ranking_equals_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(20) / 20, rng.randrange(2), rng.random() + 0.1) for _ in range(200)]
    pos, neg = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    wins = sum(a[2] * b[2] * (1 if a[0] > b[0] else 0.5 if a[0] == b[0] else 0) for a in pos for b in neg)
    assert ranked(spark, rows)[0] == pytest.approx(wins / sum(a[2] for a in pos) / sum(b[2] for b in neg))


def test_reliability_has_all_bins(spark):
    rows = backtest.reliability(spark.createDataFrame([(1.0, 1, 1.0), (0.05, 0, 1.0)], "p double, label int, weight double")).orderBy("bin").collect()
    assert [r.n for r in rows] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 1] and rows[9].observed == 1.0 and rows[5].mean_p == 0.0


def test_base_rate_weights(spark):
    df = backtest.base_rate_weights(spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int"), target=0.1)
    assert [r.weight for r in df.collect()] == pytest.approx([0.4, 1.2, 1.2, 1.2])
    assert {r.weight for r in backtest.base_rate_weights(spark.createDataFrame([(1,), (1,)], "label int"), target=0.1).collect()} == {1.0}


# Integrity


def test_attack_fixtures_are_flagged_and_an_honest_wallet_is_not(spark):
    wash = txs(spark, [(AS_OF + 3600 * i, *(("me", f"r{i % 2}") if i % 4 < 2 else (f"r{i % 2}", "me"))) for i in range(32)])
    related = spark.createDataFrame([("me", "ethereum", "r0"), ("me", "ethereum", "r1")], "address string, chain string, other string")
    w = one(integrity.wash_trading(wash, related))
    assert w.severity > 0.5 and w.partners == 2
    cohort = spark.createDataFrame([("me", "ethereum", 12)], "address string, chain string, cohort long")
    s = one(integrity.sybil_funding(txs(spark, [(5, "bank", "me")] + [(6 + i, "me", f"x{i}") for i in range(20)]), cohort))
    assert s.severity == 1.0 and s.funder == "bank"
    assert one(integrity.burst_timing(txs(spark, [(AS_OF - 400 * DAY, "me", "x")] + [(AS_OF + 3600 * i, "me", "x") for i in range(30)])), "severity") > 0.5
    fast = spark.createDataFrame([("me", "ethereum", "aave", k, 1000 * i + (12 if k == "repay" else 0), 100 * i) for i in range(6) for k in ("borrow", "repay")], LEND)
    assert (lambda r: (r.severity, r.instant))(one(integrity.instant_repay(fast))) == (1.0, 6)
    honest = txs(spark, [(AS_OF + 5 * DAY * i, "me", f"shop{i}") for i in range(40)])
    slow = spark.createDataFrame([("me", "ethereum", "aave", k, i * 100 * DAY + (80 * DAY if k == "repay" else 0), None) for i in range(2) for k in ("borrow", "repay")], LEND)
    r = one(integrity.detect(honest, slow))
    assert not r.flagged and r.penalty < 0.2


def test_burst_equals_brute_force(spark):
    rng = random.Random(8)
    times = [rng.randrange(40 * DAY) for _ in range(60)] + [5 * DAY] * 3
    span, n = max(times) - min(times), len(times)
    peak = max(sum(1 for u in times if 0 <= t - u <= 7 * DAY) for t in times)
    got = one(integrity.burst_timing(txs(spark, [(t, "me", "x") for t in times])), "severity")
    assert got == pytest.approx(min(1, max(0, (peak - n * 7 * DAY / span) / n)))


def test_instant_repay_boundaries(spark):
    rows = [("a", "c", "f", "borrow", 100, None), ("a", "c", "f", "repay", 160, None), ("b", "c", "f", "borrow", 100, None), ("b", "c", "f", "repay", 161, None), ("d", "c", "f", "borrow", 100, 7), ("d", "c", "f", "repay", 900, 8), ("e", "c", "f", "borrow", 100, 7), ("e", "c", "f", "repay", 900, 9), ("g", "c", "f", "repay", 99, 7), ("g", "c", "f", "borrow", 100, 7)]
    got = {r.address: r.instant for r in integrity.instant_repay(spark.createDataFrame(rows, LEND)).collect()}
    assert got == {"a": 1, "b": 0, "d": 1, "e": 0, "g": 0}


def test_penalty_floor_and_exemptions(spark):
    df = spark.createDataFrame([(700, 1.0, False, False), (320, 1.0, False, False), (700, 1.0, True, False), (0, 1.0, False, True)], "score int, penalty double, new_wallet boolean, no_borrow_history boolean")
    assert [r.penalised_score for r in integrity.apply_penalty(df).collect()] == [450, 300, 700, 0]


# Entities


def test_hub_funder_with_a_degree_cap(spark):
    nodes = spark.createDataFrame([(f"n{i}", "hub") for i in range(300)] + [("p", "q"), ("r", "q")], "address string, funder string")
    assert [tuple(x)[:2] for x in entity.shared_funder_pairs(nodes, degree_cap=100).collect()] == [("p", "r")]
    assert entity.shared_funder_pairs(nodes).count() == 300 * 299 // 2 + 1


def test_cospend_equals_brute_force(spark):
    rng = random.Random(6)
    times = {a: [rng.randrange(20000) for _ in range(k)] for a, k in (("a", 8), ("b", 12), ("c", 2), ("d", 5))}
    got = {(r.a, r.b): r.conf for r in entity.temporal_cospend_pairs(spark.createDataFrame([(a, t) for a, ts in times.items() for t in ts], "address string, ts long")).collect()}
    for a in times:
        for b in times:
            if a < b and min(len(times[a]), len(times[b])) >= 3:
                hits = sum(any(abs(t - u) <= 300 for u in times[b]) for t in times[a])
                assert got.get((a, b), 0) == pytest.approx(min(1, hits / min(len(times[a]), len(times[b]))))


def test_soft_or_and_clusters(spark):
    pair = lambda *rows: spark.createDataFrame(rows, "a string, b string, conf double")
    links = entity.merge_and_surface(entity.score_pairs(x=pair(("a", "b", 0.6), ("b", "c", 0.7)), y=pair(("a", "b", 0.7), ("b", "c", 0.75), ("d", "e", 0.6))))
    got = {(r.a, r.b): (round(r.confidence, 6), r.decision) for r in links.collect()}
    assert got == {("a", "b"): (0.88, "merge"), ("b", "c"): (0.925, "merge"), ("d", "e"): (0.6, "surface")}
    assert {(r.entity_id, r.address, r.size, round(r.cohesion, 6)) for r in entity.cluster(links).collect()} == {("a", x, 3, 0.88) for x in "abc"}


# Monitoring, usage, market


def test_drift_buckets_keep_out_of_range_in_the_denominator(spark):
    shares = [r.share for r in monitoring.bucket_shares(spark.createDataFrame([(1,), (10,), (20,), (99,)], "score int"), [0, 10, 20]).orderBy("bucket").collect()]
    assert shares == [0.25, 0.5]


def test_psi_of_equal_shares_is_zero(spark):
    s = spark.createDataFrame([(0, 0.5), (1, 0.5)], "bucket int, share double")
    assert one(monitoring.psi(s, s)) == (0.0, "stable")
    assert one(monitoring.psi(s, spark.createDataFrame([(0, 1.0), (1, 0.0)], "bucket int, share double")), "verdict") == "severe"


def test_metering_counts_refused_calls(spark):
    plans = spark.createDataFrame([("free", 0.0, 2, None), ("pay", 9.0, 1, 0.5)], "plan string, price double, quota long, overage double")
    subs = spark.createDataFrame([("b", "pay"), ("c", "gone")], "api_key string, plan string")
    calls = spark.createDataFrame([(i, k, AS_OF + i) for k in "abc" for i in range(4)], "event_id long, api_key string, ts long")
    got = {(r.api_key, r.used): r.reason for r in usage.meter_usage(calls, subs, plans, cap=0.9).collect()}
    assert [got["a", i] for i in (1, 2, 3, 4)] == [None, None, "QUOTA_EXCEEDED", "QUOTA_EXCEEDED"] == [got["c", i] for i in (1, 2, 3, 4)]
    assert [got["b", i] for i in (1, 2, 3, 4)] == [None, None, "OVERAGE_CAP_REACHED", "OVERAGE_CAP_REACHED"]


def test_apr_ends(spark):
    df = spark.createDataFrame([(400,), (500,), (675,), (850,)], "s int")
    assert [r[0] for r in df.select(market.offered_apr(F.col("s"), F.lit(500), F.lit(5.0), F.lit(12.0))).collect()] == [12.0, 12.0, 8.5, 5.0]


def test_csp_junk_is_dropped(spark):
    bodies = ["junk", None, "{}", "[]", '{"csp-report": {"violated-directive": "img", "blocked-uri": "u"}}', '[{"type": "csp-violation", "body": {"effectiveDirective": "img", "blockedURL": "v"}}, {"type": "other", "body": {}}]']
    rows = usage.csp_reports(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert sorted((r.directive, r.blocked, r.disposition) for r in rows) == [("img", "u", "unknown"), ("img", "v", "unknown")]


# Content


def claims(spark, text):
    return [(r.raw, r.magnitude, r.is_bound, r.is_percent) for r in content.numeric_claims(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("pos").collect()]


def test_numeric_claims(spark):
    assert claims(spark, "7,720 loans, 250K+ users, 88% of 0.849") == [("7,720", 7720.0, False, False), ("250K+", 250000.0, True, False), ("88%", 88.0, False, True), ("0.849", 0.849, False, False)]
    assert claims(spark, "v5,000 #42 chunk-2117 since 2024 https://x.y/9?z=8 `99`") == []
    assert claims(spark, "0x8894") == [("0", 0.0, False, False)]
    assert claims(spark, None) == []


def test_claims_are_backed_at_their_precision(spark):
    facts = spark.createDataFrame([(254729.0, "count", True), (0.8815, "ratio", True), (0.8489, "score", True), (77.0, "count", False)], "value double, unit string, verified boolean")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["250K+", "25K+", "200K+", "88%", "0.849", "77", "254,729", "254,000"])], "doc_id int, text string")
    assert {r.doc_id for r in content.claim_violations(content.numeric_claims(docs), facts).collect()} == {1, 5, 7}


def test_proof_violations(spark):
    texts = ["Partnered with Globex", "partnered with everyone here", "integrated with Aave", '"this is the best thing ever" - Jane Roe', "On behalf of Acme we say", "Used by teams at Initech.", "integrated with Aave today", None]
    got = [(r.doc_id, r.kind, r.entity) for r in content.proof_violations(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), allowed=["Initech"]).orderBy("doc_id").collect()]
    assert got == [(0, "partnership", "Globex"), (3, "testimonial", "Jane Roe"), (4, "impersonation", "Acme"), (6, "partnership", "Aave today")]
