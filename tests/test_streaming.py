"""Streams of files against tables: restarts, replays, late rows, sessions and keyed state."""

import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from prosemill.streaming import sessions
from prosemill.streaming.weekly import ingest_days, weekly_counts

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def feed(spark, tmp_path):
    """(folder that is read, function that delivers the k-th of six parts of the events)."""
    rows = spark.read.parquet(EVENTS).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    n = rows.count()
    parts = [rows.where((F.col("event_id") >= n * k // 6) & (F.col("event_id") < n * (k + 1) // 6)) for k in range(6)]
    (tmp_path / "in").mkdir()

    def deliver(k, name=None):
        parts[k].coalesce(1).write.parquet(f"file://{tmp_path}/made-{name or k}")
        (made,) = (tmp_path / f"made-{name or k}").glob("part-*.parquet")
        shutil.move(made, tmp_path / "in" / f"{name or k}.parquet")

    return tmp_path, deliver, rows


def read(spark, folder):
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in")


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_weeks_and_totals_after_a_restart_equal_the_table(spark, feed):
    folder, deliver, rows = feed
    for half in ((0, 1, 2), (3, 4, 5)):
        for k in half:
            deliver(k)
        for name, made, mode in (("weeks", weekly_counts(read(spark, folder), late="90 days"), "update"), ("totals", sessions.running_totals(read(spark, folder)), "update")):
            run(sessions.upsert(made, f"file://{folder}/{name}", f"file://{folder}/{name}-checkpoint", mode))
    weeks = sessions.latest(spark, f"file://{folder}/weeks", "week", "event_type")
    want = rows.groupBy(F.date_trunc("week", "ts").alias("week"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, weeks.select("week", "event_type", "n").collect())) == sorted(map(tuple, want.collect()))
    totals = sessions.latest(spark, f"file://{folder}/totals", "key").select("key", "n", "first", "last")
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, sessions.running_totals(rows).select("key", "n", "first", "last").collect()))


def test_replayed_files_count_once(spark, feed):
    folder, deliver, rows = feed
    deliver(0)
    deliver(1)
    deliver(0, "again")
    once = sessions.without_replays(sessions.timed(read(spark, folder), late="90 days"))
    run(sessions.upsert(sessions.running_totals(once), f"file://{folder}/out", f"file://{folder}/checkpoint"))
    n = sessions.latest(spark, f"file://{folder}/out", "key").agg(F.sum("n")).head()[0]
    assert n == rows.count() * 2 // 6 == sessions.without_replays(rows.where(F.col("event_id") < n).union(rows.where("event_id < 5"))).count()


def test_a_batch_that_runs_again_replaces_itself(spark, feed):
    """The sink of one batch written twice, as after a failure between write and commit."""
    folder, deliver, _ = feed
    deliver(0)
    made = sessions.running_totals(read(spark, folder))
    run(sessions.upsert(made, f"file://{folder}/out", f"file://{folder}/c1"))
    before = sorted(map(str, sessions.latest(spark, f"file://{folder}/out", "key").collect()))
    run(sessions.upsert(sessions.running_totals(read(spark, folder)), f"file://{folder}/out", f"file://{folder}/c2"))
    assert sorted(map(str, sessions.latest(spark, f"file://{folder}/out", "key").collect())) == before


def test_sessions_close_with_the_watermark_and_late_rows_drop(spark, tmp_path):
    t = datetime(2024, 1, 1, 12)
    batches = [
        [(1, t, 7), (2, t + timedelta(minutes=10), 7), (3, t + timedelta(minutes=50), 7), (4, t, 8)],
        [(5, t + timedelta(hours=5), 9), (6, t + timedelta(minutes=20), 7)],
        [(7, t - timedelta(hours=3), 7), (8, t + timedelta(hours=9), 9)],
    ]
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").coalesce(1).write.parquet(f"file://{tmp_path}/m{k}")
        shutil.move(next((tmp_path / f"m{k}").glob("part-*.parquet")), tmp_path / "in" / f"{k}.parquet")
        stream = spark.readStream.schema("event_id long, ts timestamp, user_id long").parquet(f"file://{tmp_path}/in")
        run(sessions.upsert(sessions.sessions(sessions.timed(stream, late="1 hour")), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", "append"))
    out = spark.read.parquet(f"file://{tmp_path}/out")
    got = sorted((r.user_id, r.begin, r.n) for r in out.collect())
    # row 6 came in time and joined two events that lay 40 minutes apart from it and 30 from the next; row 7 came after its time had passed
    every = spark.createDataFrame([r for b in batches for r in b if r[0] != 7], "event_id long, ts timestamp, user_id long")
    closed = sessions.sessions(every).where(F.col("finish") <= F.lit(t + timedelta(hours=8)))
    assert got == sorted((r.user_id, r.begin, r.n) for r in closed.collect()) and (9, t + timedelta(hours=5), 1) in got


def test_days_are_replaced_whole(spark, feed):
    folder, deliver, rows = feed
    for k in (0, 1):
        deliver(k)
    days = read(spark, folder).withColumn("day", F.to_date("ts"))
    run(ingest_days(days, f"file://{folder}/days", f"file://{folder}/c1"))
    first = spark.read.parquet(f"file://{folder}/days").groupBy("day").count().collect()
    run(ingest_days(days, f"file://{folder}/days", f"file://{folder}/c2"))
    assert sorted(map(tuple, spark.read.parquet(f"file://{folder}/days").groupBy("day").count().collect())) == sorted(map(tuple, first))
