"""Claims against facts: the nearest facts decide, whatever their number; plans without a nested loop."""

import math
import random

from tallyforge.operators import content

CLAIM = "doc_id long, pos int, raw string, magnitude double, is_bound boolean, is_percent boolean"
FACT = "value double, unit string, verified boolean"


def backed(c, facts):
    _, _, raw, m, bound, percent = c
    decimals = len("".join(x for x in (raw.split(".") + [""])[1] if x.isdigit()))
    for value, unit, verified in facts:
        if not verified or value is None:
            continue
        for v in [value] + ([value * 100] if percent and unit == "ratio" else []):
            if bound:
                if v >= m > 0:
                    digits = len(str(math.floor(m + 0.5)).rstrip("0"))
                    grain = 10.0 ** (math.floor(math.log10(m)) - (digits - 1))
                    if math.floor(v / grain) * grain == m:
                        return True
            elif abs(v - m) <= (10.0**-decimals if decimals else 0.5):
                return True
    return False


def test_violations_equal_a_check_of_every_pair(spark):
    rng = random.Random(3)
    facts = [(rng.choice([None, float(rng.randrange(3000)), rng.randrange(10**6) / 1000, rng.random(), 0.0]), rng.choice(["ratio", "count", None]), rng.random() < 0.8) for _ in range(60)]
    claims = []
    for i in range(500):
        if rng.random() < 0.5:
            d = rng.choice([0, 1, 2, 3])
            raw = f"{rng.random() * rng.choice([1, 10, 100, 3000]):.{d}f}"
        else:
            v = rng.choice([f[0] for f in facts if f[0]])
            raw = str(int(v)) if rng.random() < 0.5 else f"{v:.2f}"
        bound = rng.random() < 0.3
        if bound:
            raw = str(rng.choice([10, 200, 250, 2000, 1, 7, int(float(raw))]))
        claims.append((i, 0, raw, float(raw), bound, rng.random() < 0.4))
    claims += claims[:40] + [(900, 0, "0", 0.0, True, False), (901, 0, "0", 0.0, False, False)]
    df, known = spark.createDataFrame(claims, CLAIM), spark.createDataFrame(facts, FACT)
    out = content.claim_violations(df, known)
    assert sorted(map(tuple, out.collect())) == sorted(c for c in claims if not backed(c, facts)) and 50 < out.count() < 500
    assert sorted(map(tuple, content.claim_violations(df, known.limit(0)).collect())) == sorted(claims)


def test_a_million_facts_meet_claims_without_a_nested_loop(spark):
    facts = spark.range(1_000_000).selectExpr("cast(id * 3 as double) AS value", "'count' AS unit", "true AS verified")
    claims = spark.range(3000).selectExpr("id AS doc_id", "0 AS pos", "cast(id as string) AS raw", "cast(id as double) AS magnitude", "false AS is_bound", "false AS is_percent")
    out = content.claim_violations(claims, facts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.doc_id for r in out.collect()} == {i for i in range(3000) if i % 3}


def test_a_title_is_checked_and_nulls_keep_their_rows(spark):
    posts = [(1, "x", 100, "we are fine", None), (2, "x", 101, "fine", "Grew 999 %"), (3, None, None, None, None), (4, "email", 102, "hello {{unsubscribe_url}}", "News"), (5, "email", 103, "hello", "{{unsubscribe_url}}"), (6, "x", None, "ok", "ok"), (7, "email", 104, "more {{unsubscribe_url}}", "")]
    df = spark.createDataFrame(posts, "doc_id long, channel string, posted long, text string, title string")
    got = {r.doc_id: r.decision for r in content.check_and_decide(df, spark.createDataFrame([(5.0, "count", True)], FACT), site="own.example").collect()}
    assert got == {1: "ready", 2: "BLOCKED", 3: "ready", 4: "ready", 5: "BLOCKED", 6: "ready", 7: "deferred"}
