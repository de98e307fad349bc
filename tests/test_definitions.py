"""Cases in which a plausible reading differs from what the tables mean."""

from tallyforge.operators import features, market, monitoring, usage


def test_convergence_is_a_share_of_all_wallets(spark):
    df = spark.createDataFrame([(10, 750), (20, 600), (400, 800), (500, 500)], "age int, score int")
    assert tuple(monitoring.high_score_convergence(df).select("n", "share").first()) == (4, 0.25)
    assert tuple(monitoring.high_score_convergence(df.limit(0)).select("n", "share").first()) == (0, 0.0)


def test_a_subscription_holds_for_its_chain(spark):
    history = spark.createDataFrame([("W1", "base", 1, 1, 500)], "address string, chain string, ts long, event_id long, score long")
    subs = spark.createDataFrame([("s1", "w1", "base", None), ("s1", "w1", "polygon", None), ("s2", "w1", "base", 9)], "subscription_id string, address string, chain string, revoked_at long")
    assert [(r.subscription_id, r.chain) for r in monitoring.score_changes(history, subs).collect()] == [("s1", "base")]


def test_refused_reviews_take_no_turn(spark):
    loans = spark.createDataFrame([(1, "REPAID", "a", "b")], "loan_id int, status string, lender string, borrower string")
    rows = [(1, 1, "A", 9, 10), (2, 1, "x", 5, 11), (3, 1, "a", 5, 12), (4, 1, "A", 4, 13)]
    got = market.review_eligibility(spark.createDataFrame(rows, "review_id int, loan_id int, reviewer string, rating int, created long"), loans)
    assert {r.review_id: r.reason for r in got.collect()} == {1: "bad rating", 2: "not a party", 3: "ok", 4: "already reviewed"}


def test_a_review_told_twice_is_not_before_itself(spark):
    loans = spark.createDataFrame([(1, "REPAID", "a", "b")], "loan_id int, status string, lender string, borrower string")
    rows = [(1, 1, "a", 5, 10), (1, 1, "a", 4, 10), (2, 1, "a", 5, 10), (3, 1, "b", 5, 10)]
    got = market.review_eligibility(spark.createDataFrame(rows, "review_id int, loan_id int, reviewer string, rating int, created long"), loans)
    assert sorted((r.review_id, r.rating, r.reason) for r in got.collect()) == [(1, 4, "ok"), (1, 5, "ok"), (2, 5, "already reviewed"), (3, 5, "ok")]


def test_names_have_one_label_and_64_characters(spark):
    names = ["a.b.eth", "ok-1.eth", "x" * 61 + ".eth", "x" * 60 + ".eth"]
    got = features.valid_addresses(spark.createDataFrame([(n,) for n in names], "address string")).collect()
    assert [r.address_kind for r in got] == ["invalid", "ens", "invalid", "ens"]


def test_null_keys_keep_their_rows(spark):
    out = spark.createDataFrame([(1, 10, 5.0, None, "EXECUTED"), (2, 11, 5.0, "x", "EXECUTED"), (3, None, 5.0, None, "EXECUTED")], "event_id long, ts long, amount double, channel string, status string")
    assert usage.spend_cap_audit(out, day_cap=100, channel_cap=100).count() == 3
    body = '{"metadata": {"apiKeyId": "%s", "planId": "pro"}}'
    events = spark.createDataFrame([("checkout.session.completed", body % "", 1, 1), ("checkout.session.completed", '{"metadata": {"apiKeyId": 7, "planId": "pro"}}', 1, 2), ("checkout.session.completed", body % "k", 1, 3), ("checkout.session.completed", "junk", 1, 4)], "type string, body string, at long, event_id long")
    assert [r.api_key for r in usage.subscription_state(events).collect()] == ["k"]
