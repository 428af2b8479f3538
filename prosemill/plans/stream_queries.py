"""Queries of streams: events read as a stream of files, run to its end inside the query, and held against batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.files import shared_folder
from ..streaming import sessions
from ..streaming.weekly import weekly_counts
from .catalog import query, read

SESSIONS = """e as (select user_id, ts, lag(ts) over (partition by user_id order by ts) before from events),
c as (select user_id, ts, sum(case when before is null or ts - before >= interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) k from e)"""


def stream(spark, sf_dir):
    """The table as a stream of its files; a pattern, as a table may be a single file."""
    return spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


def run(spark, rows, *keys, mode="update"):
    """What the stream's result comes to: all batches run, the newest row of each key."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    sessions.upsert(rows, f"{at}/rows", f"{at}/checkpoint", mode).awaitTermination()
    return sessions.latest(spark, f"{at}/rows", *keys)


@query("event_sessions", f"with {SESSIONS} select user_id, epoch_us(min(ts)) as begin_us, epoch_us(max(ts)) + 1800000000 as finish_us, count(*) n from c group by user_id, k")
def q_sessions(spark, sf_dir):
    """Session windows: runs of a user's events with less than half an hour between them."""
    made = sessions.sessions(sessions.timed(read(spark, sf_dir, "events")))
    return made.select("user_id", F.unix_micros("begin").alias("begin_us"), F.unix_micros("finish").alias("finish_us"), "n")


@query("stream_weekly", "select epoch_us(date_trunc('week', ts)) // 1000000 as week_s, event_type, count(*) n from events group by all")
def q_stream_weekly(spark, sf_dir):
    """C20 C22 as a stream: weekly counts by type, updated batch by batch."""
    weeks = run(spark, weekly_counts(stream(spark, sf_dir), late="60 days"), "week", "event_type")
    return weeks.select(F.unix_seconds("week").alias("week_s"), "event_type", "n")


@query("stream_totals", "select cast(user_id as varchar) as \"key\", count(*) n, epoch_us(min(ts)) first_us, epoch_us(max(ts)) last_us from events group by user_id")
def q_stream_totals(spark, sf_dir):
    """Keyed state over batches: each user's events so far, with the first and the last."""
    totals = run(spark, sessions.running_totals(stream(spark, sf_dir)), "key")
    return totals.select("key", "n", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))
