"""URL filter by a dated list: validity intervals and an as-of join, in DataFrame operations alone.

List entries (key, listed_on, action) say that from a date on, hosts at or below
key are blocked ("block") or no longer blocked ("unlist"). Ordered by date they
become intervals [listed_on, next entry's date). Every capture looks up the
suffixes of its host among the intervals that hold on its fetch date; the
longest active key decides.

Defined results: one row a capture, repeated ones included; a null or
unusual URL has no host and is kept; a null fetch date meets no interval; of
several entries for a key on a date, "block" wins; an empty list keeps all; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def intervals(entries: DataFrame) -> DataFrame:
    """(key, valid_from, valid_to or null, action): what each key's latest entry says, while it is the latest."""
    one = entries.where("key is not null and listed_on is not null").groupBy("key", "listed_on").agg(F.min("action").alias("action"))
    return one.select("key", F.col("listed_on").alias("valid_from"), F.lead("listed_on").over(Window.partitionBy("key").orderBy("listed_on")).alias("valid_to"), "action")


def filter_urls(captures: DataFrame, entries: DataFrame, max_broadcast_rows: int = 100_000) -> DataFrame:
    """page_id, url, fetched_on, host, matched_key, listed_on, kept."""
    host = F.nullif(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))
    # repeated captures are judged once and given back as often as they came
    rows = captures.groupBy("page_id", "url", "fetched_on").agg(F.count("*").alias("copies")).withColumn("host", host)
    parts = F.split("host", r"\.")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))
    wanted = rows.where("host is not null").select("page_id", "url", "fetched_on", F.explode(keys).alias("key"))
    spans = intervals(entries)
    if spans.count() <= max_broadcast_rows:  # about 10 MB at most; a longer list is joined by shuffling on the key
        spans = F.broadcast(spans)
    active = wanted.join(spans, "key").where("fetched_on >= valid_from and (valid_to is null or fetched_on < valid_to)")
    best = active.groupBy("page_id", "url", "fetched_on").agg(F.max(F.struct(F.length("key").alias("n"), "key", F.col("valid_from").alias("listed_on"), "action")).alias("m"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("page_id", "url", "fetched_on")]
    judged = rows.alias("r").join(best.alias("b"), same, "left").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return judged.select("r.page_id", "r.url", "r.fetched_on", "r.host", F.col("b.m.key").alias("matched_key"), F.col("b.m.listed_on").alias("listed_on"), F.coalesce(F.col("b.m.action") != "block", F.lit(True)).alias("kept"))


def dated(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch time: page_id deals the pages over the days of 2024."""
    return pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id, 366) as int))").alias("fetched_on"))


def demo_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the table: a quarter is listed on some day and taken off later, and example.org for one summer."""
    hosts = pages.select(F.lower(F.regexp_extract("url", HOST, 1)).alias("key")).where("key <> ''").distinct().withColumn("m", F.md5("key"))
    digit = lambda k: F.expr(f"instr('0123456789abcdef', substr(m, {k}, 1)) - 1")
    hosts = hosts.select("key", digit(1).alias("d1"), digit(2).alias("d2"), digit(3).alias("d3")).where("d1 < 4")
    on = hosts.select("key", F.expr("date_add(date'2024-01-01', d2 * 10)").alias("listed_on"), F.lit("block").alias("action"))
    off = hosts.select("key", F.expr("date_add(date'2024-06-09', d3 * 10)").alias("listed_on"), F.lit("unlist").alias("action"))
    fixed = pages.sparkSession.sql("select 'example.org' key, date'2024-06-01' listed_on, 'block' action union all select 'example.org', date'2024-09-01', 'unlist'")
    return on.unionByName(off).unionByName(fixed)


SQL = r"""
with cap as (select page_id, url, date '2024-01-01' + cast(page_id % 366 as int) fetched_on from pages),
r as (select *, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') host from cap),
h as (select key, instr('0123456789abcdef', substr(md5(key), 1, 1)) - 1 d1, instr('0123456789abcdef', substr(md5(key), 2, 1)) - 1 d2, instr('0123456789abcdef', substr(md5(key), 3, 1)) - 1 d3 from (select distinct host as key from r where host is not null)),
e as (select key, date '2024-01-01' + cast(d2 * 10 as int) listed_on, 'block' as "action" from h where d1 < 4
  union all select key, date '2024-06-09' + cast(d3 * 10 as int), 'unlist' from h where d1 < 4
  union all select 'example.org', date '2024-06-01', 'block' union all select 'example.org', date '2024-09-01', 'unlist'),
one as (select key, listed_on, min("action") as "action" from e group by 1, 2),
iv as (select *, lead(listed_on) over (partition by key order by listed_on) valid_to from one),
m as (select r.page_id, r.url, r.fetched_on, iv.key, iv.listed_on, iv."action", row_number() over (partition by r.page_id, r.url, r.fetched_on order by length(iv.key) desc) k
  from r join iv on (r.host = iv.key or right(r.host, length(iv.key) + 1) = '.' || iv.key) and r.fetched_on >= iv.listed_on and (iv.valid_to is null or r.fetched_on < iv.valid_to))
select r.page_id, r.url, r.fetched_on, r.host, m.key matched_key, m.listed_on, coalesce(m."action" <> 'block', true) kept
from r left join m on r.page_id is not distinct from m.page_id and r.url is not distinct from m.url and r.fetched_on is not distinct from m.fetched_on and m.k = 1
"""
