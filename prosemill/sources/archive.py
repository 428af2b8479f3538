"""The day archive S14 S15 K8: postings in day folders, published by a manifest.

    <path>/postings/day=2024-01-05/stamp=<writer>/part-….parquet   rows of a day, as one writer left them
    <path>/manifest/day=2024-01-05/part-….parquet                  one row: the stamp that holds, and the day's summary

A writer adds folders of its own and then replaces the manifest's rows of its days (dynamic partition overwrite), so a
reader sees a day as it was or as it is, never half of it; a writer that fails or runs again leaves folders that no
manifest names. Reads go through the manifest: only the day and stamp folders it names are opened, whether days are
given as bounds (static) or come from a table (dynamic partition pruning). Summaries are read from the manifest alone.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import vocabulary

POSTINGS = "doc_id long, author string, signed boolean, word string, tf long, day date, stamp string"
SUMMARY = "stamp string, docs long, signed_docs long, signed_authors long, unsigned_authors long, words long, postings long"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each day that is published: SUMMARY and day; none where nothing was written."""
    schema = f"{SUMMARY}, day date"
    try:
        return spark.read.schema(schema).parquet(f"{path}/manifest")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def write_days(postings: DataFrame, path: str, force: bool = False) -> str:
    """K8: publish (day, doc_id, author, signed, word, tf) by day; days that are there stay unless forced. Returns the stamp.

    Days are gathered into files by a rebalance, which splits large days and joins small ones at run time. Postings may
    come in their documents, as a column bag in the place of word and tf; they are taken apart behind the rebalance.
    """
    spark, stamp = postings.sparkSession, uuid.uuid4().hex
    if not force:
        postings = postings.join(manifest(spark, path).select("day"), "day", "left_anti")
    names = [c.split()[0] for c in POSTINGS.split(", ")]
    own = [c for c in names if c in postings.columns]
    dealt = postings.select(*own, *(["bag"] if "bag" in postings.columns else [])).hint("rebalance", "day")
    apart = dealt.select(*own, F.inline("bag")) if "bag" in postings.columns else dealt
    apart.withColumn("stamp", F.lit(stamp)).select(*names).write.mode("append").partitionBy("day", "stamp").parquet(f"{path}/postings")
    # what was written is what is summed up: a second look at the source could differ
    written = spark.read.schema(POSTINGS).parquet(f"{path}/postings").where(F.col("stamp") == stamp)
    summary = summed(written).withColumn("stamp", F.lit(stamp))
    summary.select(*(c.split()[0] for c in SUMMARY.split(", ")), "day").coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/manifest")
    return stamp


def summed(postings: DataFrame) -> DataFrame:
    """By day: documents, documents and authors of either side, words and postings."""
    # texts as keys are counted in a hash table, where their first() would sort all postings
    some = postings.groupBy("day", "doc_id", "author", "signed").agg(F.count("*").alias("n"))
    docs = some.groupBy("day", "doc_id").agg(F.first("author").alias("author"), F.first("signed").alias("on"), F.sum("n").alias("n"))
    on, off = F.col("on"), ~F.col("on")
    by = docs.groupBy("day").agg(F.count("*").alias("docs"), F.sum(on.cast("long")).alias("signed_docs"), F.countDistinct(F.when(on, F.col("author"))).alias("signed_authors"), F.countDistinct(F.when(off, F.col("author"))).alias("unsigned_authors"), F.sum("n").alias("postings"))
    return by.join(postings.select("day", "word").distinct().groupBy("day").agg(F.count("*").alias("words")), "day")


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """The days' summary lines, without opening a posting."""
    return manifest(spark, path).drop("stamp")


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, days: DataFrame | None = None) -> DataFrame:
    """The published postings of all days, of those from first to last, or of those in a table with the column day."""
    # every stamp is above "": the planner prunes by a joined table only where that is filtered
    held = manifest(spark, path).select("day", "stamp").where("stamp > ''")
    rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    for test in [F.col("day") >= F.lit(first).cast("date")] * bool(first) + [F.col("day") <= F.lit(last).cast("date")] * bool(last):
        held, rows = held.where(test), rows.where(test)
    if days is not None:
        held = held.join(days.select("day").distinct(), "day", "left_semi")
    # a row a day: what is broadcast grows with the calendar, not with the rows
    return rows.join(F.broadcast(held), ["day", "stamp"]).drop("stamp")


def window_words(spark: SparkSession, path: str, first: str, last: str, min_df: int) -> DataFrame:
    """(word, df, tf) of the vocabulary of window(), counted as the postings are read: no posting meets its word by a join."""
    return read_days(spark, path, first, last).groupBy("word").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).where(F.col("df") >= min_df)


def window(spark: SparkSession, path: str, first: str, last: str, min_df: int) -> DataFrame:
    """The postings of a window of days over one vocabulary, of words in min_df documents of the window."""
    some = read_days(spark, path, first, last)
    return some.join(vocabulary(some, min_df).select("word"), "word")
