"""The coordinate join against brute force over all pairs."""

import random
from math import comb

import numpy as np
import pytest
from prose_words import prose

from tallyforge.llm import minhash
from tallyforge.llm.words import LOWER, mix, shingle_sets


def brute(rows):
    """{position: (set size, smallest id reachable)} by comparing all pairs of sets that share a shingle."""
    sets = [set(x.tolist()) for x in shingle_sets([(t or "").encode().translate(LOWER) for _, t in rows], 4)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if r not in least else min((least[r], d), key=lambda v: (v is None, v or 0))
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def edited(text, rng, share):
    words = text.split()
    for _ in range(max(1, int(len(words) * share))):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("pivots", [1, 3])
def test_components_equal_brute_force(spark, monkeypatch, pivots):
    monkeypatch.setattr(minhash, "PIVOTS", pivots)
    rng = random.Random(8)
    rows = [(100 + i, prose(i, rng.choice([3, 4, 5, 12, 60, 300]))) for i in range(40)]
    for k in range(12):
        text, copies = prose(500 + k, rng.choice([30, 80, 200, 900])), []
        for _ in range(rng.choice([2, 5, 14])):
            text = edited(text, rng, rng.choice([0.01, 0.03, 0.05, 0.08])) if rng.random() < 0.7 else text.upper()
            copies.append(text)
        rows += [(1000 * (k + 1) + i, t) for i, t in enumerate(copies)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one  two\tthree"), (8, "a b c d"), (8, "a b c d"), (9, "x" * 9000), (None, prose(500, 50)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS keys", "3 AS size", "4 AS label", "'c' AS lanes", "5 AS short").repartition(4)
    found = minhash.CoordinateJoin(df).components()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect() for _ in range(r.copies)), key=str)
    want = brute(rows)
    assert got == want and len({c for _, _, c in want}) < len(rows) - 40


def test_kept_rows(spark, make_dir):
    text = prose(7, 100)
    d = make_dir([(3, text, "en", "a", 1), (2, text, "en", "a", 1), (5, text + " end", "en", "a", 1), (9, None, "en", "a", 1), (9, None, "en", "a", 1), (10, prose(8, 90), "en", "a", 1)])
    got = sorted(map(tuple, minhash.op12_minhash(spark, d).collect()))
    assert got == [(2, 97, 2, True), (3, 97, 2, False), (5, 98, 2, False), (9, 0, 9, True), (9, 0, 9, True), (10, 87, 10, True)]
    kept = minhash.stay(spark.read.parquet(f"{d}/documents.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9, 9, 10] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_signatures_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(2)
    pool, agreed, low = mix(np.arange(1, 400_000, dtype=np.uint64)), [], 0
    for _ in range(300):
        own = rng.choice(pool, 180, replace=False)
        x, y = minhash.signature(np.sort(own[:162])), minhash.signature(np.sort(np.concatenate((own[18:162], own[162:]))))  # 144 of 180 in common
        agreed.append(int((x == y).sum()))
        low += agreed[-1] < minhash.MATCHES
    assert abs(np.mean(agreed) / minhash.COORDINATES - 0.8) < 0.02 and low == 0
    assert sum(comb(64, i) * 0.8**i * 0.2 ** (64 - i) for i in range(minhash.MATCHES)) < 5e-6


def test_collisions_are_counted_from_lanes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for same in (0, 1, 36, 63, 64):
        x = rng.integers(0, 2**63, 64).astype(np.uint64)
        y = x.copy()
        y[rng.permutation(64)[same:]] ^= np.uint64(1) << rng.integers(0, 16, 64 - same).astype(np.uint64)
        rows.append((same, minhash.lanes(x).tolist(), minhash.lanes(y).tolist()))
    df = spark.createDataFrame(rows, "same int, x array<long>, y array<long>")
    assert all(r[0] == r[1] for r in df.select("same", minhash.collisions(df.x, df.y)).collect())


def test_a_large_family_is_compared_with_few_members(spark):
    """Hundreds of edited copies of one text are linked by their central members and never paired with each other."""
    rng = random.Random(3)
    base = prose(77, 200)
    rows = [(i, edited(base, rng, 0.01)) for i in range(400)]
    join = minhash.CoordinateJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    lists = join._lists()
    assert join._pivot_pairs(lists).count() <= minhash.PIVOTS * len(rows) and join._across(lists.where("short"), join.labels).count() == 0
    assert {r.component_id for r in join.components().collect()} == {0}
