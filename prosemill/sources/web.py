"""Sources on the web as Spark data sources: search windows S13, pages S4, snapshots S18.

    web.register(spark)
    spark.read.format("prose_search").option("address", "https://…/search").option("days", "2024-01-01..2024-01-31").load()

Each window, page or snapshot is an input partition of its own, so they are fetched by the executors, in parallel, and a
lost one is fetched again alone. Refusals (403, 429) are tried again after a pause; other failures end the read. Requests
are spaced without any coordination: partition k sends nothing before k times the pace has gone by since planning, and
each waits for the pace between its own pages. Addresses may use any scheme that urllib opens.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from urllib.error import HTTPError
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Refusals that pass; tries, pause and pace in seconds; windows of a day and their minutes; rows of a page.
REFUSED = (403, 429)
TRIES, PAUSE, PACE = 4, 10.0, 2.2
WINDOWS, MINUTES, PER_PAGE = 10, 5, 100


def windows_of(day: str, n: int = WINDOWS, minutes: int = MINUTES) -> list[tuple[datetime, datetime]]:
    """The day's windows, as files.day_windows draws them: one in each equal part, its place from a hash of the date."""
    state = 0.0
    for c in day:
        state = float((int(state) * 31 + ord(c)) % (1 << 32))
    part, start, out = 86_400 // n, datetime.fromisoformat(day).replace(tzinfo=UTC), []
    for k in range(n):
        state = (state * 1103515245.0 + 12345.0) % 4294967296.0
        at = start + timedelta(seconds=k * part + int(state / 4294967296.0 * ((part - minutes * 60) * 1000)) // 1000)
        out.append((at, at + timedelta(minutes=minutes)))
    return out


def days_of(spec: str) -> list[str]:
    """The days of "first..last" or of a list with commas."""
    if ".." not in spec:
        return [d.strip() for d in spec.split(",") if d.strip()]
    first, last = (date.fromisoformat(d.strip()) for d in spec.split("..", 1))
    return [str(first + timedelta(days=k)) for k in range((last - first).days + 1)]


@dataclass
class Task(InputPartition):
    """What one partition fetches: an address, and where its rows belong."""

    address: str
    place: tuple
    not_before: float


class Fetcher:
    """Requests with tries, pauses and pace; headers carry a token where there is one."""

    def __init__(self, options: dict):
        self.tries, self.pause, self.pace = int(options.get("tries", TRIES)), float(options.get("pause", PAUSE)), float(options.get("pace", PACE))
        token = options.get("token")
        self.headers = {"User-Agent": "prosemill"} | ({"Authorization": f"Bearer {token}"} if token else {})

    def tasks(self, places: list[tuple[str, tuple]]) -> list[Task]:
        now = time.time()
        return [Task(address, place, now + k * self.pace) for k, (address, place) in enumerate(places)]

    def get(self, address: str, missing: bool = False) -> tuple[bytes, str] | None:
        """(body, content type); None for an address that is not there, if that is no error."""
        for _ in range(self.tries):
            try:
                with urlopen(Request(address, headers=self.headers)) as answer:
                    return answer.read(), (answer.headers.get("Content-Type") or "").lower()
            except HTTPError as e:
                if e.code in REFUSED:
                    time.sleep(self.pause)
                elif missing and e.code in (404, 410):
                    return None
                else:
                    raise ConnectionError(f"{address}: {e.code} {e.reason}") from None
        raise ConnectionError(f"{address}: refused {self.tries} times")

    def wait(self, until: float) -> None:
        time.sleep(max(0.0, until - time.time()))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def _need(self, name: str) -> str:
        if not self.options.get(name):
            raise ValueError(f"option {name} is missing")
        return self.options[name]


class SearchReader(_Reader):
    def partitions(self) -> list[Task]:
        o = self.options
        address, text = self._need("address"), o.get("query", "")
        stamp = lambda t: t.isoformat().replace("+00:00", "Z")
        places = []
        for day in days_of(self._need("days")):
            for k, (a, b) in enumerate(windows_of(day, int(o.get("windows", WINDOWS)), int(o.get("minutes", MINUTES)))):
                q = f"{text} created:{stamp(a)}..{stamp(b)}".strip()
                places.append((f"{address}?{urlencode({'q': q, 'per_page': o.get('per_page', PER_PAGE)}, quote_via=quote)}", (day, k)))
        return Fetcher(o).tasks(places)

    def read(self, task: Task) -> Iterator[tuple]:
        fetch, most = Fetcher(self.options), int(self.options.get("per_page", PER_PAGE))
        day, window = task.place
        fetch.wait(task.not_before)
        page = 1
        while True:
            items = json.loads(fetch.get(f"{task.address}&page={page}")[0]).get("items") or []
            for x in items:
                user = x.get("user") or {}
                yield date.fromisoformat(day), window, x.get("created_at"), user.get("login"), user.get("type"), x.get("repository_url"), x.get("body")
            if len(items) < most:
                return
            page += 1
            time.sleep(fetch.pace)


class PageReader(_Reader):
    def partitions(self) -> list[Task]:
        return Fetcher(self.options).tasks([(a, ()) for a in self._need("path").split("\n") if a.strip()])

    def read(self, task: Task) -> Iterator[tuple]:
        fetch = Fetcher(self.options)
        fetch.wait(task.not_before)
        body, kind = fetch.get(task.address)
        name = "md" if "markdown" in kind else "txt" if "text/plain" in kind else "html"
        yield task.address, body.decode("utf-8", "replace").removeprefix("﻿"), name


class SnapshotReader(_Reader):
    def partitions(self) -> list[Task]:
        """The versions that a listing names; `file` has {id} in its place."""
        fetch = Fetcher(self.options)
        listed = json.loads(fetch.get(self._need("listing"))[0])
        return fetch.tasks([(self._need("file").replace("{id}", x["sha"]), (x["sha"],)) for x in listed])

    def read(self, task: Task) -> Iterator[tuple]:
        fetch = Fetcher(self.options)
        fetch.wait(task.not_before)
        got = fetch.get(task.address, missing=True)
        if got:
            yield task.place[0], got[0].decode("utf-8", "replace")


class SearchSource(DataSource):
    """The items of each window of each day, all their pages."""

    @classmethod
    def name(cls) -> str:
        return "prose_search"

    def schema(self) -> str:
        return "day date, window int, ts string, author string, type string, repo string, body string"

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)


class PageSource(DataSource):
    """Addresses, one a line, as (name, src, kind); the kind comes from the content type, html where it says nothing."""

    @classmethod
    def name(cls) -> str:
        return "prose_pages"

    def schema(self) -> str:
        return "name string, src string, kind string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


class SnapshotSource(DataSource):
    """(id, value) of the versions of a published file; those that are gone have no row."""

    @classmethod
    def name(cls) -> str:
        return "prose_snapshots"

    def schema(self) -> str:
        return "id string, value string"

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (SearchSource, PageSource, SnapshotSource):
        spark.dataSource.register(source)


def search(spark: SparkSession, address: str, days: str, **options) -> DataFrame:
    """Items of the windows of "first..last" days."""
    register(spark)
    return spark.read.format("prose_search").options(address=address, days=days, **options).load()


def read_pages(spark: SparkSession, addresses: list[str], **options) -> DataFrame:
    """Many addresses, fetched by the executors."""
    register(spark)
    return spark.read.format("prose_pages").options(path="\n".join(addresses), **options).load()


def web_snapshots(spark: SparkSession, listing: str, file: str, **options) -> DataFrame:
    """(generated, word, rank) of the versions that the listing names; versions of an older shape have no rows."""
    from .inputs import parsed_snapshots

    register(spark)
    return parsed_snapshots(spark.read.format("prose_snapshots").options(listing=listing, file=file, **options).load())
