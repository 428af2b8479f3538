"""What is published from the other operators' tables: page data K12, the rule catalogue K13, marker proposals K15, dumps K9.

Published tables are JSON lines with a section each, so they are written in parallel; stale() compares two of them.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_sample(summaries: DataFrame) -> DataFrame:
    """By Monday week: days, documents and signed documents of the sampled days."""
    week = F.date_trunc("week", F.col("day").cast("timestamp")).cast("date")
    return summaries.groupBy(week.alias("week")).agg(F.count("*").alias("days"), F.sum("docs").alias("docs"), F.sum("signed_docs").alias("signed_docs"))


def sections(**tables: DataFrame) -> DataFrame:
    """(section, line): the rows of each table as JSON, to be written as text by section."""
    rows = None
    for name, t in tables.items():
        one = t.select(F.lit(name).alias("section"), F.to_json(F.struct(*t.columns)).alias("line"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def page_data(clusters: DataFrame, summaries: DataFrame, history: DataFrame) -> DataFrame:
    """The sections of the page: totals of the sample, its weeks, the clusters, and each word's rank by build.

    clusters as of corpus.clusters_of() with words; summaries of sources.archive.summaries(); history: built, word, rank.
    """
    total = summaries.agg(F.count("*").alias("days"), F.min("day").alias("from"), F.max("day").alias("to"), F.sum("docs").alias("docs"), F.sum("signed_docs").alias("signed_docs"))
    ranks = history.groupBy("word").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("built").cast("string").alias("built"), "rank")))).alias("ranks"))  # one entry a build
    return sections(sample=total, weeks=weekly_sample(summaries), clusters=clusters, words=ranks)


def stale(published: DataFrame, now: DataFrame) -> DataFrame:
    """Lines that are published and no longer hold, or hold and are not published; none if it is current."""
    gone = published.select("section", "line").exceptAll(now.select("section", "line")).withColumn("state", F.lit("outdated"))
    return gone.unionByName(now.select("section", "line").exceptAll(published.select("section", "line")).withColumn("state", F.lit("missing")))


def _cell(text: str | None, most: int | None = None) -> str:
    return re.sub(r"\s+", " ", text or "").replace("|", r"\|").strip()[:most]


def catalogue(sets: list[dict]) -> str:
    """The rules of the sets as Markdown tables; sets are control data."""
    out = ["# Rules", ""]
    for s in sets:
        out += [f"## {s.get('title') or s['name']}: `{s['name']}`", "", _cell(s.get("description"), 400), "", "| rule | flags | fix |", "|-|-|-|"]
        out += [f"| `{r['id']}` | {_cell(r.get('description'), 150)} | {_cell(r.get('suggest'))} |" for r in s["rules"]] + [""]
    return "\n".join([*out, f"{sum(len(s['rules']) for s in sets)} rules in {len(sets)} sets.", ""])


def catalogue_is_current(sets: list[dict], path: str) -> bool:
    """Whether the file holds what catalogue() gives."""
    return Path(path).is_file() and Path(path).read_text("utf-8") == catalogue(sets)
