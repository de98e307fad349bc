"""Hubs: a funder of very many wallets, and a moment in which all wallets are active."""

import random

import pytest

from tallyforge.operators import entity
from tallyforge.plans import cells

NODE = "address string, funder string, gas_funder string"


def told(links):
    return sorted((r.a, r.b, round(r.confidence, 9), sorted(r.signals), r.decision) for r in links.collect())


def test_cliques_leave_out_only_what_they_say(spark):
    rng = random.Random(1)
    nodes = spark.createDataFrame([(f"w{i:02d}", rng.choice(["hub", "hub", "f1", "f2", None]), None) for i in range(40)], NODE)
    pair = lambda n, conf: spark.createDataFrame([(*sorted(rng.sample([f"w{i:02d}" for i in range(40)], 2)), conf) for _ in range(n)], "a string, b string, conf double").dropDuplicates(["a", "b"])
    signals = {"bridge": pair(40, 0.75), "direct_transfer": pair(60, 0.4), "temporal_cospend": pair(10, 1.0)}
    links, cliques = entity.resolve(nodes, **signals)
    whole = entity.merge_and_surface(entity.score_pairs(shared_funder=entity.shared_funder_pairs(nodes), **signals))
    implied = [r for r in told(whole) if r[3] == ["shared_funder"]]
    assert told(links) == [r for r in told(whole) if r[3] != ["shared_funder"]] and implied and {(r[2], r[4]) for r in implied} == {(0.6, "surface")}
    both = links.where("array_contains(signals, 'shared_funder')").select("a", "b").distinct().collect()
    assert sum(int(c.pairs) for c in cliques.collect()) == len(implied) + len(both)
    members = lambda x: sorted((r.address, r.entity_id, round(r.cohesion, 9)) for r in entity.cluster(x).collect())
    assert members(links) == members(whole)


def test_links_are_rounded_once(spark):
    nodes = spark.createDataFrame([("a", None, None), ("b", None, None), ("c", None, None)], NODE)
    pair = lambda *rows: spark.createDataFrame(rows, "a string, b string, conf double")
    links, _ = entity.resolve(nodes, gas_funding=pair(("a", "b", 0.7), ("b", "c", 0.75)), temporal_cospend=pair(("a", "b", 0.015625), ("b", "c", 0.4)))
    tie = 1 - (1 - 0.7) * (1 - 0.015625)  # just below 0.7046875
    assert {(r.a, r.confidence, r.six, r.decision) for r in links.selectExpr("*", "round(confidence, 6) AS six").collect()} == {("a", tie, 0.704687, "surface"), ("b", 1 - (1 - 0.75) * (1 - 0.4), 0.85, "merge")}


def test_a_funder_of_a_million_wallets_costs_one_row_each(spark):
    nodes = spark.range(1_000_000).selectExpr("concat('w', id) AS address", "'hub' AS funder", "cast(null as string) AS gas_funder")
    links, cliques = entity.resolve(nodes, bridge=spark.range(1000).selectExpr("concat('w', 2 * id) AS x", "concat('w', 2 * id + 1) AS y").selectExpr("least(x, y) AS a", "greatest(x, y) AS b", "0.75 AS conf"))
    got = links.selectExpr("count(*) AS n", "min(confidence) AS lo", "max(confidence) AS hi", "count_if(decision = 'merge') AS merges").first()
    assert (got.n, got.merges) == (1000, 1000) and got.lo == got.hi == pytest.approx(0.9)
    c = cliques.first()
    assert (c.funder, c.members, int(c.pairs)) == ("hub", 1_000_000, 499_999_500_000)


@pytest.mark.parametrize("cell", [3, 10_000])
def test_cospend_in_a_crowded_moment_equals_plain_loops(spark, cell):
    rng = random.Random(2)
    times = [(f"a{i:02d}", 3000 + rng.randrange(280)) for i in range(30) for _ in range(4)] + [(f"a{rng.randrange(30):02d}", rng.randrange(9000)) for _ in range(120)]
    df = spark.createDataFrame(times, "address string, ts long")
    own = {}
    for a, t in times:
        own.setdefault(a, []).append(t)
    want = {}
    for a in own:
        for b in own:
            if a < b and len(own[a]) >= 3 and len(own[b]) >= 3:
                close = sum(any(abs(t - u) <= 300 for u in own[b]) for t in own[a])
                if close:
                    want[a, b] = min(1.0, close / min(len(own[a]), len(own[b])))
    got = {(r.a, r.b): r.conf for r in entity.temporal_cospend_pairs(df, cell=cell).collect()}
    assert got == pytest.approx(want)


def test_no_cell_holds_more_than_its_share(spark):
    ticks = spark.range(5000).selectExpr("concat('a', id) AS a", "id AS t", "7 AS bucket")
    near = spark.range(3000).selectExpr("concat('b', id) AS b", "7 AS at")
    x, y = entity._grid(ticks, near, 1000)
    assert x.groupBy("row", "column").count().agg({"count": "max"}).first()[0] < 1200 and y.groupBy("at_row", "at_column").count().agg({"count": "max"}).first()[0] < 1200
    assert x.count() == 5000 * 3 and y.count() == 3000 * 5


def plain_cospend(times, tolerance=300):
    own = {}
    for a, t in times:
        own.setdefault(a, []).append(t)
    busy = sorted(a for a in own if len(own[a]) >= 3)
    close = {(a, b): sum(any(abs(t - u) <= tolerance for u in own[b]) for t in own[a]) for a in busy for b in busy if a < b}
    return {p: min(1.0, n / min(len(own[p[0]]), len(own[p[1]]))) for p, n in close.items() if n}


@pytest.mark.parametrize(("wallets", "ticks", "hot", "far"), [(4000, 10**6, 10**5, 0), (9, 10**6, 10**5, 2**33), (30, 40, 25, 0)])
def test_cospend_in_cells_equals_plain_loops(spark, monkeypatch, wallets, ticks, hot, far):
    """One block; blocks of nine and times too far apart for an int; blocks of few ticks, and wallets too hot for any."""
    rng = random.Random(5)
    monkeypatch.setattr(cells, "WALLETS", wallets)
    monkeypatch.setattr(cells, "TICKS", ticks)
    monkeypatch.setattr(cells, "MEETINGS", 50)
    monkeypatch.setattr(entity, "HOT_TICKS", hot)
    times = [(f"w{rng.randrange(40)}", rng.choice([rng.randrange(9000), far + rng.randrange(900), 3000])) for _ in range(500)] + [("é" if i % 2 else "whale", rng.randrange(9000)) for i in range(80)]
    df = spark.createDataFrame([*times, (None, 5), (None, 6), (None, 7)], "address string, ts long")
    want = plain_cospend(times)
    for dense in (True, False):
        got = [(r.a, r.b, r.conf) for r in entity.temporal_cospend_pairs(df, dense=dense).collect()]
        assert {(a, b): c for a, b, c in got} == pytest.approx(want) and len(got) == len(want)


def test_pairs_that_nearly_all_meet_are_not_shuffled(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(f"w{i % 400:03d}", rng.randrange(3000)) for i in range(4000)], "address string, ts long")
    out = entity.temporal_cospend_pairs(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan  # each pair is counted where it is written
    assert out.count() == 400 * 399 // 2
    sparse = spark.createDataFrame([(f"w{i:03d}", 10_000 * i + t) for i in range(400) for t in (1, 2, 3)], "address string, ts long")
    assert "Join" in entity.temporal_cospend_pairs(sparse)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("beside", [True, False])
def test_links_in_cells_are_those_of_joined_signals(spark, monkeypatch, beside):
    rng = random.Random(8)
    monkeypatch.setattr(cells, "WALLETS", 9)
    monkeypatch.setattr(cells, "DENSE", 30)
    monkeypatch.setattr(entity, "HOT_TICKS", 20)
    names = [f"w{i:02d}" for i in range(40)]
    nodes = spark.createDataFrame([(w, rng.choice(["hub", "hub", "f1", None]), None) for w in names], NODE)
    times = spark.createDataFrame([(rng.choice(names[5:]), rng.randrange(40_000)) for _ in range(300)] + [("w09", 1500 * i) for i in range(25)], "address string, ts long")
    pair = lambda n, conf: spark.createDataFrame([(*sorted(rng.sample([*names, "out", "zed"], 2)), conf) for _ in range(n)], "a string, b string, conf double").dropDuplicates(["a", "b"])
    signals = {"bridge": pair(80, 0.75), "direct_transfer": pair(60, 0.4), "gas_funding": pair(5, 0.0)}
    cospend = entity.temporal_cospend_pairs(times, dense=False)
    if beside:
        want = entity.resolve(nodes, temporal_cospend=cospend, **signals)[0]
    else:
        want = entity.merge_and_surface(entity.score_pairs(shared_funder=entity.shared_funder_pairs(nodes), temporal_cospend=cospend, **signals))
    exact = lambda links: sorted((r.a, r.b, r.confidence, tuple(r.signals), r.n_signals, r.decision) for r in links.collect())
    for dense in (True, False):
        got = exact(entity.merge_and_surface(entity.linked_pairs(nodes, times, beside=beside, dense=dense, **signals)))
        assert got == exact(want)
        merged = exact(entity.merge_and_surface(entity.linked_pairs(nodes, times, beside=beside, dense=dense, floor=entity.MERGE, **signals)))
        assert merged == [r for r in got if r[5] == "merge"] and merged


@pytest.mark.parametrize("name", ["g6_named_pairs", "g7_merge_and_surface", "g6_score_pairs"])
def test_queries_score_pairs_where_they_are_counted(spark, name):
    from tallyforge.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "bucket" not in plan
