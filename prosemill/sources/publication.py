"""Versioned publication of a table K10 K12: stage, compare, swap.

    <path>/data/<stamp>/part-….parquet     rows of one version
    <path>/versions/00000007.json          what version 7 is: its folder, number of rows, digest and token

A writer stages its rows in a folder of its own, which nobody reads, and then claims the next version number by creating
its file, which only one writer can: of writers that started from the same version one goes on, and the others start
again from what it published. Readers take the highest number. A writer whose rows equal the current version's publishes
nothing, and one that comes back with a token that is already in the history changes nothing.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import latest_wins


class Conflict(Exception):
    """Another writer has published since the version that this one started from."""


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[dict]:
    """The history, oldest first. It is control data: a line a version."""
    fs, folder = _fs(spark, f"{path}/versions")
    if not fs.exists(folder):
        return []
    names = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(folder)) if re.fullmatch(r"\d{8}\.json", n))
    rows = spark.read.text([f"{path}/versions/{n}" for n in names], wholetext=True).select("value").collect() if names else []
    return sorted((json.loads(r.value) for r in rows if r.value), key=lambda v: v["version"])


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with text unless it is there; False if it is."""
    if path.startswith("file:"):
        # the local file system of Hadoop looks first and creates then; the operating system does both at once
        local = "/" + path.removeprefix("file:").lstrip("/")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        made = f"{local}.{uuid.uuid4().hex}"
        with open(made, "w") as f:
            f.write(text)
        try:
            os.link(made, local)  # whole or not at all
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(made)
    fs, p = _fs(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table whatever the order of its rows: exact sums of two hashes of each row."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    row = F.struct(*columns)
    hashes = [F.xxhash64(row), F.xxhash64(F.lit("again"), F.to_json(row, {"ignoreNullFields": "false"}))]
    n, *sums = df.agg(F.count("*"), *(F.sum(h.cast("decimal(38,0)")) for h in hashes)).head()
    return n, ":".join(str(s or 0) for s in sums)


def current(spark: SparkSession, path: str) -> dict | None:
    return next(reversed(versions(spark, path)), None)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version, the newest by default; None where nothing is published."""
    of = {v["version"]: v for v in versions(spark, path)}
    if not of:
        return None
    v = of[max(of) if version is None else version]
    return spark.read.parquet(f"{path}/data/{v['stamp']}")


def stage(df: DataFrame, path: str) -> dict:
    """Write rows where nobody reads them yet, and say what they are."""
    stamp = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{stamp}")
    rows, told = digest(df.sparkSession.read.schema(df.schema).parquet(f"{path}/data/{stamp}"))
    return {"stamp": stamp, "rows": rows, "digest": told}


def swap(spark: SparkSession, path: str, staged: dict, before: dict | None, token: str | None = None) -> dict:
    """Make staged rows the version after `before`; Conflict if that number is taken, `before` if the rows are its own."""
    if before and (before["rows"], before["digest"]) == (staged["rows"], staged["digest"]):
        return before
    version = staged | {"version": before["version"] + 1 if before else 1, "token": token}
    if not _create(spark, f"{path}/versions/{version['version']:08d}.json", json.dumps(version)):
        raise Conflict(f"version {version['version']} of {path} is taken")
    return version


def publish(spark: SparkSession, path: str, build: Callable[[DataFrame | None], DataFrame], token: str | None = None, tries: int = 20) -> dict:
    """Publish build(rows of the current version or None), started again from the newest version until no other writer comes between."""
    for _ in range(tries):
        history = versions(spark, path)
        done = next((v for v in history if token and v["token"] == token), None)
        if done:
            return done
        before = history[-1] if history else None
        staged = stage(build(spark.read.parquet(f"{path}/data/{before['stamp']}") if before else None), path)
        try:
            return swap(spark, path, staged, before, token)
        except Conflict:
            continue
    raise Conflict(f"{path}: {tries} tries, and another writer came first each time")


def upsert(new: DataFrame, path: str, key: str, token: str | None = None) -> dict:
    """Rows of new in place of those with the same key; the latest wins."""
    return publish(new.sparkSession, path, lambda held: new if held is None else latest_wins(held, new, key), token)
