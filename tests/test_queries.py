"""Registered queries against their SQL on the smallest sample tables, and the driver contract."""

import os

import pytest

import __spark_entry__ as entry
from tallyforge import queries_more as batch

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "~" if v is None or v != v else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(batch.SQL))
def test_query_equals_sql(spark, duck, name):
    df = batch.QUERIES[name](spark, DIR)
    got = duck.execute(batch.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(got.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(batch.QUERIES) - set(batch.SQL)))
def test_query_without_sql_runs(spark, name):
    assert batch.QUERIES[name](spark, DIR).count() > 0


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_numeric_claims_equal_a_plain_scan(spark):
    import re

    number = re.compile(r"(\d[\d,]*(?:\.\d+)?)\s*([kKmMbB])?\s*(\+)?\s*(%|percent)?")
    want = []
    for r in batch._content(spark, DIR).collect():
        text = re.sub(r"`[^`]*`", " ", re.sub(r"https?://\S+", " ", r.text))
        for m in number.finditer(text):
            bare = m[1].replace(",", "")
            if re.match(r"[A-Za-z0-9_#@/-]", text[m.start() - 1 : m.start()]) or re.fullmatch(r"(19|20)\d\d", bare) and not (m[2] or m[3] or m[4]):
                continue
            want.append((r.doc_id, float(bare) * {"k": 1e3, "m": 1e6, "b": 1e9}.get((m[2] or "").lower(), 1.0), bool(m[3]), bool(m[4])))
    got = [(r.doc_id, r.magnitude, r.is_bound, r.is_percent) for r in batch.QUERIES["k1_numeric_claims"](spark, DIR).collect()]
    assert sorted(got) == sorted(want) and want


def test_blocked_content_is_what_the_faults_say(spark):
    rows = {r.doc_id: r for r in batch.QUERIES["k4_publish_decision"](spark, DIR).collect()}
    faulty = {r.doc_id for r in batch.QUERIES["k2_claim_violations"](spark, DIR).collect()} | {r.doc_id for r in batch.QUERIES["k3_proof_violations"](spark, DIR).collect()}
    text = {r.doc_id: r.text for r in batch._content(spark, DIR).collect()}
    for i, r in rows.items():  # a fourth of the titles claims a number
        assert (r.decision == "BLOCKED") == (i in faulty or i % 4 == 1 or r.channel == "email" and "{{unsubscribe_url}}" not in text[i])


def test_late_rows_and_repeats_of_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyforge import streaming

    day = 86400
    for i, rows in enumerate([[("w", "h1", 10 * day), ("w", "h1", 10 * day)], [("w", "h2", 20 * day)], [("w", "h3", 1 * day), ("w", "h4", 20 * day)]]):
        spark.createDataFrame(rows, "address string, hash string, sec long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("address string, hash string, sec long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_seconds("sec"))
    got = streaming.latest(streaming.run_available(streaming.stream_activity(stream), "late", mode="update"), ["address", "start"])
    counts = {r.day: r.tx_count for r in got.select((F.unix_seconds("start") / day).cast("int").alias("day"), "tx_count").collect()}
    assert counts == {10: 1, 20: 2}
