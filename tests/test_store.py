"""The versioned store: what a commit changes and what it leaves, failures, conflicts, repeats, old versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import features, labels
from tallyforge.sources.store import Conflict, Store

DDL = "a string, k long, x double"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "t"), DDL, ["a", "k"], partitions=8, within=["a"])


def rows_of(spark, rows):
    return spark.createDataFrame(rows, DDL + ", seq long")


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(store):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{store.path}/data") for f in names if f.endswith(".parquet")}


def test_upserts_equal_a_dictionary(spark, store):
    rng, want = random.Random(1), {}
    assert store.read().count() == 0 and store.version().number == 0
    for i in range(4):
        rows = [(rng.choice(["p", "q", "r", "s", None]), rng.randrange(6), float(100 * i + j), j) for j in range(25)]
        store.upsert(rows_of(spark, rows), order="seq")
        for a, k, x, _ in rows:
            want[a, k] = x
        assert told(store.read()) == sorted(((a, k, x) for (a, k), x in want.items()), key=str)
    assert store.versions() == [4, 3, 2, 1]


def test_untouched_partitions_keep_their_files_and_readers_their_version(spark, store):
    store.upsert(rows_of(spark, [(c, 1, 0.0, 0) for c in "abcdefgh"]))
    before, at, opened = files(store), store.version(), store.read()
    change = rows_of(spark, [("a", 1, 9.0, 0), ("a", 2, 8.0, 0)])
    touched = store.parts_of(change)
    store.upsert(change)
    now = store.version()
    assert len(touched) == 1 and before <= files(store)
    assert {p for p in at.parts if at.parts[p] != now.parts[p]} == set(touched)
    assert {("a", 1, 9.0), ("a", 2, 8.0)} <= set(told(store.read())) and told(opened) == told(store.read(1)) == sorted((c, 1, 0.0) for c in "abcdefgh")
    with pytest.raises(LookupError):
        store.read(17)


def test_a_failed_write_changes_nothing(spark, store):
    store.upsert(rows_of(spark, [("a", 1, 1.0, 0), ("b", 1, 1.0, 0)]))
    was = told(store.read())
    bad = rows_of(spark, [("a", 1, 5.0, 0)])
    with pytest.raises(Exception, match="lost"):  # while the rows are written
        store.merge(bad, lambda both: both.withColumn("x", F.when(F.col("new") == 1, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("x"))))
    commit = store._commit
    store._commit = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):  # after the rows, before the manifest
        store.upsert(bad)
    store._commit = commit
    assert told(store.read()) == was and store.versions() == [1]
    store.upsert(bad)
    assert store.vacuum(keep=1) >= 1 and told(store.read()) == [("a", 1, 5.0), ("b", 1, 1.0)] and store.versions() == [2]


def test_of_two_writers_one_fails(spark, store):
    store.upsert(rows_of(spark, [("a", 1, 1.0, 0)]))
    slow = store.version()
    store.upsert(rows_of(spark, [("a", 1, 2.0, 0)]))
    with pytest.raises(Conflict):
        store._commit(slow, slow.parts, None)
    assert told(store.read()) == [("a", 1, 2.0)] and not [n for n in os.listdir(f"{store.path}/log") if n.startswith(".") and not n.endswith(".crc")]


def test_batches_are_taken_once(spark, store):
    one = rows_of(spark, [("a", 1, 1.0, 0)]).drop("seq")
    for _ in range(2):
        store.append(one, batch=("s", 0))
    store.append(one, batch=("s", 1))
    store.append(one, batch=("other", 0))
    assert store.read().count() == 3 and store.version().batches == {"s": 1, "other": 0}
    assert store.upsert(one.limit(0), batch=("s", 2)).batches["s"] == 2


def test_appends_pile_up_until_compacted(spark, store):
    for i in range(4):
        store.append(rows_of(spark, [("a", i, float(i), 0), (None, i, 0.0, 0)]).drop("seq"))
    assert {len(v) for v in store.version().parts.values()} == {4} and store.read().count() == 8
    was = told(store.read())
    store.compact(most=2)
    assert {len(v) for v in store.version().parts.values()} == {1} and told(store.read()) == was
    store.merge(rows_of(spark, [("a", 9, 0.0, 0)]).drop("seq"), lambda both: both.where("a is null"))  # a partition may become empty
    assert {r[0] for r in told(store.read())} == {None}
    with pytest.raises(ValueError, match="own"):
        Store(spark, store.path, "v int", ["v"])


def test_stored_features_never_show_the_future(spark, tmp_path):
    fs = labels.feature_store(spark, str(tmp_path / "f"), partitions=4)
    snap = lambda rows: spark.createDataFrame([(a, "base", t, v, [x], 1.0, i) for i, (a, t, v, x) in enumerate(rows)], "address string, chain string, valid_at_ts long, feature_set_version string, features array<double>, completeness double, seq long")
    labels.put(fs, snap([("w", 10, "v5", 1.0), ("w", 20, "v5", 2.0), ("w", 15, "v4", 9.0), ("u", 10, "v5", 7.0)]))
    labels.put(fs, snap([("w", 20, "v5", 3.0), ("w", 30, "v5", 4.0)]))
    ask = spark.createDataFrame([(i, "w", "base", t) for i, t in enumerate((9, 10, 19, 20, 99))] + [(9, "nobody", "base", 50)], "request_id int, address string, chain string, as_of_ts long")
    got = {r.request_id: r.features and r.features[0] for r in labels.stored_as_of(fs, ask, version="v5").collect()}
    assert got == {0: None, 1: 1.0, 2: 1.0, 3: 3.0, 4: 4.0, 9: None}
    assert {r.features and r.features[0] for r in labels.stored_as_of(fs, ask.where("request_id = 3"), version="v5", at=1).collect()} == {2.0}


def test_a_lost_sync_is_repeated_without_a_second_row(spark, tmp_path):
    stores = features.score_stores(spark, str(tmp_path / "s"), partitions=4)
    results = spark.createDataFrame([("W1", 600, 10, "C"), ("w1", 650, 20, "B"), ("w2", 500, 20, "D")], "address string, score long, scored_at long, grade string")
    append = stores[1].append
    stores[1].append = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        features.sync_scores(stores, results, batch=("b", 1))
    stores[1].append = append
    for _ in range(2):
        features.sync_scores(stores, results, batch=("b", 1))
    features.sync_scores(stores, spark.createDataFrame([("w1", 700, 15)], "address string, score long, scored_at long"), batch=("b", 2))
    assert told(stores[0].read().select("address", "score", "grade", "scored_at")) == [("w1", 650, "B", 20), ("w2", 500, "D", 20)]
    assert told(stores[1].read().select("address", "score")) == [("w1", 600), ("w1", 650), ("w1", 700), ("w2", 500)]
