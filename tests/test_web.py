"""Web data sources against a server of this test: paging, refusals, spacing, parts of their own."""

import json
import threading
import time
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from prosemill.operators import corpus
from prosemill.sources import web
from prosemill.sources.files import day_windows

EVENTS = "/root/testdata/sf0.01/events.parquet"


@pytest.fixture(scope="module")
def server(spark):
    rows = [(r.ts, r.user_id, r.event_type) for r in spark.read.parquet(EVENTS).select("ts", "user_id", "event_type").collect()]
    seen: list[tuple[float, str]] = []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def answer(self, code, body=b"", kind="application/json"):
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            at = urlsplit(self.path)
            first = self.path not in [p for _, p in seen]
            seen.append((time.time(), self.path))
            if at.path == "/search":
                q = parse_qs(at.query)
                if first and hash(self.path) % 3 == 0:
                    return self.answer(429)
                a, b = (datetime.fromisoformat(x.replace("Z", "+00:00")).replace(tzinfo=None) for x in q["q"][0].split("created:")[1].split(".."))
                n, page = int(q["per_page"][0]), int(q["page"][0])
                found = sorted(r for r in rows if a <= r[0] < b)[(page - 1) * n : page * n]
                return self.answer(200, json.dumps({"items": [{"created_at": str(t), "user": {"login": str(u), "type": "User"}, "repository_url": k, "body": "x"} for t, u, k in found]}).encode())
            if at.path == "/versions":
                return self.answer(200, json.dumps([{"sha": s} for s in ("new", "gone", "old")]).encode())
            if at.path == "/file/new":
                return self.answer(200, ("window.x = " + json.dumps({"generated": "2026-01-02", "components": [{"lead": False, "word_list": ["no"]}, {"lead": True, "word_list": ["b", "a"]}]}) + ";").encode())
            if at.path == "/file/old":
                return self.answer(200, b"window.x = {};")
            if at.path == "/page.md":
                return self.answer(200, "﻿# Título".encode(), "text/markdown; charset=utf-8")
            if at.path == "/page":
                return self.answer(200, b"<p>x</p>", "")
            if at.path == "/never":
                return self.answer(403)
            self.answer(404)

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_windows_are_those_of_the_table(spark):
    days = spark.sql("select explode(array(date'2024-01-05', date'2025-12-31')) as day")
    for r in day_windows(days).collect():
        a, b = web.windows_of(str(r.day))[r.window]
        assert (a.hour * 3600 + a.minute * 60 + a.second, (b - a).seconds) == (r.start_second, r.seconds)


def test_search_equals_the_sampled_table(spark, server):
    """Windows of a few events each: pages of two, some of them refused at first."""
    base, seen = server
    got = web.search(spark, f"{base}/search", "2024-01-03..2024-01-06", per_page="2", pace="0", pause="0.05")
    assert got.rdd.getNumPartitions() == 40
    e = spark.read.parquet(EVENTS).select(F.col("ts").cast("timestamp").alias("ts"), "user_id").withColumn("day", F.to_date("ts")).where("day between date'2024-01-03' and date'2024-01-06'")
    want = corpus.window_sample(e, day_windows(e.select("day").distinct())).groupBy("day", "window").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    assert sorted(map(tuple, got.groupBy("day", "window").agg(F.count("*").alias("n"), F.countDistinct("author").alias("users")).collect())) == sorted(map(tuple, want.collect()))
    assert want.count() > 10 and any("page=2" in p for _, p in seen)


def test_requests_are_spaced(spark, server):
    base, seen = server
    seen.clear()
    web.search(spark, f"{base}/search", "2024-01-08", pace="0.15", pause="0").collect()
    firsts = sorted({p: t for t, p in reversed(seen)}.values())
    assert len(firsts) == 10 and firsts[-1] - firsts[0] >= 9 * 0.15 - 0.4


def test_refusals_and_failures_end_the_read(spark, server):
    base, _ = server
    with pytest.raises(Exception, match="refused 2 times"):
        web.read_pages(spark, [f"{base}/never"], pace="0", pause="0", tries="2").collect()
    with pytest.raises(Exception, match="404"):
        web.read_pages(spark, [f"{base}/nothing"], pace="0").collect()
    with pytest.raises(Exception, match="option days is missing"):
        spark.read.format("prose_search").option("address", base).load().collect()


def test_pages(spark, server):
    base, _ = server
    got = web.read_pages(spark, [f"{base}/page.md", f"{base}/page"], pace="0")
    assert sorted(map(tuple, got.collect())) == [(f"{base}/page", "<p>x</p>", "html"), (f"{base}/page.md", "# Título", "md")]


def test_snapshots(spark, server):
    base, _ = server
    got = web.web_snapshots(spark, f"{base}/versions", f"{base}/file/{{id}}", pace="0")
    assert sorted((str(r.generated), r.word, r.rank) for r in got.collect()) == [("2026-01-02", "a", 2), ("2026-01-02", "b", 1)]
