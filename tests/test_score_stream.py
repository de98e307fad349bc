"""Score changes as a stream: late and equal times, repeats, expiry of the state, and the batch twin."""

import random

from pyspark.sql import functions as F

from tallyforge import streaming
from tallyforge.operators import monitoring

DAY = 86400
ROW = "address string, chain string, ts long, event_id long, score long"


def stream(spark, path, batches):
    """Each batch in a file of its own, taken one at a time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(f"{path}/b={i:03d}")
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def told(df):
    return sorted((r.address, r.ts, r.event_id, r.score, r.previous) for r in df.collect())


def test_equal_to_the_batch_twin_on_rows_in_order(spark, tmp_path):
    rng, rows = random.Random(1), []
    for i in range(240):
        rows.append((rng.choice("abc"), "base", 10**6 + 1000 * (i // 3), i, 500 + rng.randrange(40)))  # three rows of each time
    got = streaming.run_available(streaming.stream_score_changes(stream(spark, str(tmp_path), [rows[i : i + 60] for i in range(0, 240, 60)])), "changes")
    want = monitoring.score_changes(spark.createDataFrame(rows, ROW))
    assert told(got) == told(want) and len(told(got)) > 20


def test_late_rows_and_repeats_change_nothing(spark, tmp_path):
    batches = [
        [("a", "base", 10 * DAY, 1, 500)], [("a", "base", 10 * DAY, 3, 540), ("a", "base", 10 * DAY, 2, 505)],
        [("a", "base", 10 * DAY, 3, 540), ("a", "base", 9 * DAY, 9, 800)],  # a repeat, and one that comes late
        [("a", "base", 11 * DAY, 4, 545)], [("a", "base", 12 * DAY, 5, 560)],
    ]
    got = streaming.run_available(streaming.stream_score_changes(stream(spark, str(tmp_path), batches)), "late")
    assert told(got) == [("a", 10 * DAY, 1, 500, None), ("a", 10 * DAY, 3, 540, 505), ("a", 12 * DAY, 5, 560, 545)]


def test_wallets_are_forgotten(spark, tmp_path):
    batches = [[(f"w{i}", "base", 10 * DAY, i, 500) for i in range(20)]] + [[("w0", "base", d * DAY, 100 + d, 500)] for d in (15, 20, 25, 30, 45, 46)] + [[("w1", "base", 47 * DAY, 300, 501)]]
    source = stream(spark, str(tmp_path / "in"), batches)
    out, seen = streaming.stream_score_changes(source, late="1 day", keep_days=10), []
    q = out.writeStream.outputMode("append").foreachBatch(lambda df, b: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) >= 20 and kept[-1] < max(kept) / 2
    firsts = sorted((r.address, r.ts) for r in seen if r.previous is None and r.address in ("w0", "w1"))
    assert firsts == [("w0", 10 * DAY), ("w0", 45 * DAY), ("w1", 10 * DAY), ("w1", 47 * DAY)]  # w0 paused for more than ten days
