"""The report for readers (K1), the budget gate (K6), the one-line clip (K7) and URL scans.

A report is a table of numbered lines per file, so it is written in parallel;
reading it in order of (file, place) gives the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import one_line

#: Occurrences shown below a document-level finding.
SHOWN = 5


def report_lines(found: DataFrame, stats: DataFrame, context: bool = False, suggest: bool = False) -> DataFrame:
    """K1: (file, place, line) of the files with findings.

    found: file, line, col, rule, match, sentence, suggest, count, measure (null for spans) and occurrences, an array
    of (line, col, context). stats: file, ws_words. A line may be null where its part does not apply; those are dropped.
    """
    indent = " " * 11
    where = F.when(F.col("measure").isNotNull(), F.lit("document")).otherwise(F.concat_ws(":", F.col("line").cast("string"), F.col("col").cast("string")))
    badge = F.when(F.col("count").isNotNull(), F.concat(F.lit(" ×"), F.col("count").cast("string"))).otherwise("")
    head = F.concat(F.lit("  "), F.rpad(where, 9, " "), F.lit(" "), F.rpad("rule", 21, " "), badge, F.lit(" "), one_line(F.coalesce("measure", "match"), 88))
    occ = F.coalesce("occurrences", F.array().cast("array<struct<line:int,col:int,context:string>>"))
    some = occ if context else F.slice(occ, 1, SHOWN)
    below = F.transform(some, lambda o: F.concat(F.lit("  "), F.lpad(F.concat_ws(":", o.line.cast("string"), o.col.cast("string")), 9, " "), F.lit(" "), one_line(o.context, 96)))
    more = F.when(F.size(occ) > F.size(some), F.concat(F.lit(indent), F.lit(" … "), (F.size(occ) - F.size(some)).cast("string"), F.lit(" more")))
    around = F.when(F.col("measure").isNull() & (F.trim("sentence") != F.trim("match")), F.concat(F.lit(indent + " "), one_line(F.col("sentence"), 132))) if context else F.lit(None).cast("string")
    fix = F.when(F.col("suggest") != "", F.concat(F.lit(indent + " fix: "), F.col("suggest"))) if suggest else F.lit(None).cast("string")
    lines = F.array_compact(F.concat(F.array(head), F.when(F.col("measure").isNotNull(), below).otherwise(F.array().cast("array<string>")), F.array(F.when(F.col("measure").isNotNull(), more), around, fix)))
    body = found.select("file", F.struct(F.col("line").alias("at_line"), F.col("col").alias("at_col"), "rule").alias("at"), F.posexplode(lines).alias("sub", "text"))
    sizes = found.groupBy("file").agg(F.count("*").alias("n")).join(stats.select("file", "ws_words"), "file")
    title = sizes.select("file", F.lit(None).cast(body.schema["at"].dataType).alias("at"), F.lit(-1).alias("sub"), F.format_string("%s (%d words, %d findings)", "file", "ws_words", "n").alias("text"))
    return body.unionByName(title).select("file", F.struct(F.col("at").isNotNull().alias("in_body"), "at", "sub").alias("place"), F.col("text").alias("line"))


def budget_exit(per_1000: float, total: int, max_per_1000: float | None = None, most: int | None = None, exit_zero: bool = False) -> int:
    """K6: 1 where the findings go over the budget; the rate comes before the count."""
    if exit_zero:
        return 0
    if max_per_1000 is not None:
        return int(per_1000 > max_per_1000)
    return int(most is not None and total > most)


def read_url(spark: SparkSession, url: str, opener=None, most: int = 64_000_000) -> DataFrame:
    """One (name, src, kind) row of an http(s) URL; kind from the content type, html where it says nothing.

    opener is urllib's unless given. A page of over `most` bytes is an error, as it comes by way of the driver.
    """
    from urllib.request import urlopen

    if not url.lower().startswith(("http://", "https://")):
        raise ValueError(f"not a web address: {url}")
    with (opener or urlopen)(url) as answer:
        kind = (answer.headers.get("Content-Type") or "").lower()
        raw = answer.read(most + 1)
    if len(raw) > most:
        raise ValueError(f"{url} is longer than {most} bytes")
    name = "md" if "markdown" in kind else "txt" if "text/plain" in kind else "html"
    return spark.createDataFrame([(url, raw.decode("utf-8", "replace").removeprefix("﻿"), name)], "name string, src string, kind string")
