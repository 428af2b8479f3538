"""Streams of events: sessions, weekly counts and running totals by key, with late rows, replays and restarts.

An extension beyond the batch operators, which take days at a time (C11, K8): the functions take streams and tables
alike, and what a stream has written so far equals what the table of its rows gives. Sinks are idempotent: a micro-batch
that runs again replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, ts: str = "ts", late: str | None = None) -> DataFrame:
    """events with ts as a timestamp and, for a stream, how late a row may come; later ones are dropped."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, late) if late else rows


def without_replays(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event once, however often its file is delivered; a stream keeps keys as long as its watermark asks for."""
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """(key, begin, finish, n): runs of a key's events with less than the gap between neighbours; finish is the last event's time plus the gap.

    A stream emits a session once its watermark has passed it.
    """
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), "n")


TOTALS = "key string, n long, first timestamp, last timestamp"


def running_totals(events: DataFrame, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """TOTALS by key over all batches so far, a row for each key that a batch touches; of a table, one row a key.

    State is three numbers a key. Rows of a key reach the function in Arrow batches, so a hot key is not held whole.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    if not events.isStreaming:
        return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))

    def add(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last = state.get if state.exists else (0, None, None)
        for frame in frames:
            n += len(frame)
            lo, hi = frame["ts"].min().to_pydatetime(), frame["ts"].max().to_pydatetime()
            first, last = lo if first is None else min(first, lo), hi if last is None else max(last, hi)
        state.update((n, first, last))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "first": [first], "last": [last]})

    return rows.groupBy("key").applyInPandasWithState(add, TOTALS, "n long, first timestamp, last timestamp", "update", GroupStateTimeout.NoTimeout)


def upsert(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """Runs over all that is there and stops. Each micro-batch has a folder named by its number, so one that is replayed replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The newest row of each key that upsert() has written."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("age", F.row_number().over(newest)).where("age = 1").drop("age", "batch")
