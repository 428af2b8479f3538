"""What a run is pointed at: targets S3 S5 S7, fragment payloads S8 K5, rule-set files and manifests S9, configuration S11, authored JSON R14, snapshots S18.

Targets, links and sets are control data on the driver; the texts they name are read by Spark.
"""

from __future__ import annotations

import base64
import gzip
import json
from functools import reduce
from pathlib import Path
from urllib.parse import parse_qs, quote, urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import validate_set
from .files import EXTENSIONS, kind_of, read_folder, read_zip

CONFIG = "prose.json"
#: Links of more characters are cut by some tools.
LONG_LINK = 60_000


# ------------------------------------------------------------------ targets


def read_targets(spark: SparkSession, targets: list[str], recursive: bool = False, exclude: list[str] = (), stdin=None, opener=None) -> DataFrame:
    """(name, src, kind) of files, folders, web addresses and "-" for standard input.

    A folder needs recursive, but for "." as the only target.
    """
    from .report import read_url

    rows = []
    for t in targets or ["-"]:
        if t == "-":
            rows.append(read_stdin(spark, stdin))
        elif t.lower().startswith(("http://", "https://")):
            rows.append(read_url(spark, t, opener))
        elif Path(t).is_dir():
            if not recursive and not (t == "." and len(targets) == 1):
                raise ValueError(f"{t} is a folder: ask for recursion to read it")
            rows.append(read_folder(spark, str(Path(t).resolve()), list(exclude)))
        elif Path(t).is_file():
            rows.append(kind_of(spark.read.text(str(Path(t).resolve()), wholetext=True).select(F.lit(t).alias("name"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("src"))))
        else:
            raise FileNotFoundError(t)
    return reduce(DataFrame.unionByName, rows)


def read_stdin(spark: SparkSession, stdin=None) -> DataFrame:
    """Standard input as one Markdown source."""
    import sys

    return spark.createDataFrame([("<stdin>", (stdin or sys.stdin).read().removeprefix("﻿"), "md")], "name string, src string, kind string")


def read_drop(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The prose files of a folder and of the zip archives in it, in order of name, and one row with how many other files were skipped."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    hidden = F.col("path").rlike(r"/\.[^/]|/node_modules/")
    prose = F.lower("path").rlike(r"\.(?:" + "|".join(EXTENSIONS) + r")\z")
    skipped = listed.where(~hidden & ~prose & ~F.lower("path").endswith(".zip")).agg(F.count("*").alias("skipped"))
    files = read_folder(spark, path)
    zips = [r.path for r in listed.where(F.lower("path").endswith(".zip") & ~hidden).collect()]  # archives of one drop
    if zips:
        files = files.unionByName(reduce(DataFrame.unionByName, (read_zip(spark, z) for z in zips)))
    return files.orderBy("name"), skipped


# ------------------------------------------------------------------ fragment payloads


def _packed(data: bytes) -> str:
    return base64.urlsafe_b64encode(gzip.compress(data, mtime=0)).decode().rstrip("=")


def _bytes(data: str) -> bytes:
    return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4))


def _unpacked(data: str) -> bytes:
    return gzip.decompress(_bytes(data))


def share_link(base: str, sources: list[tuple[str, str, str]], select: list[str] = (), ignore: list[str] = (), rules: list[str] = ()) -> tuple[str, bool]:
    """K5: a link that carries (name, src, kind) of the sources, and whether it is too long for some tools."""
    if len(sources) == 1:
        name, src, kind = sources[0]
        parts = [("url", name)] if name.lower().startswith(("http://", "https://")) else [("gz", _packed(src.encode())), ("kind", kind), *([("name", name)] if name != "<stdin>" else [])]
    else:
        parts = [("bundle", _packed(json.dumps([{"name": n, "kind": k, "src": s} for n, s, k in sources], ensure_ascii=False).encode()))]
    parts += [("select", ",".join(select))] * bool(select) + [("ignore", ",".join(ignore))] * bool(ignore)
    parts += [("rules", r) for r in rules if r.lower().startswith(("http://", "https://"))]
    link = base.rstrip("/") + "/#" + "&".join(f"{k}={quote(v, safe='')}" for k, v in parts)
    return link, len(link) > LONG_LINK


def read_payload(spark: SparkSession, link: str, opener=None) -> tuple[DataFrame, dict]:
    """The sources a link carries (the first of bundle, gz, text and url; all but url in base64url), and its select, ignore and rules."""
    from .report import read_url

    got = parse_qs(link.partition("#")[2], keep_blank_values=True)
    one = lambda k, other="": got.get(k, [other])[0]
    options = {"select": [x for x in one("select").split(",") if x], "ignore": [x for x in one("ignore").split(",") if x], "rules": got.get("rules", [])}
    schema = "name string, src string, kind string"
    if one("bundle"):
        rows = [(d["name"], d["src"], d.get("kind", "md")) for d in json.loads(_unpacked(one("bundle")))]
    elif one("gz") or one("text"):
        src = (_unpacked(one("gz")) if one("gz") else _bytes(one("text"))).decode("utf-8", "replace")
        rows = [(one("name", "shared"), src, one("kind", "md"))]
    elif one("url"):
        return read_url(spark, one("url"), opener), options
    else:
        rows = []
    return spark.createDataFrame(rows, schema), options


# ------------------------------------------------------------------ rule sets and configuration


def parse_set(text: str, name: str = "unnamed") -> dict:
    """A set from JSON as written by hand, a bare list of rules included; errors name the line and column."""
    try:
        got = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"{name}: line {e.lineno}, column {e.colno}: {e.msg}") from None
    if isinstance(got, list):
        got = {"name": name, "rules": got}
    if not isinstance(got, dict) or not isinstance(got.get("rules"), list):
        raise ValueError(f"{name}: a set has a list of rules")
    return validate_set({"name": name} | got)


def _text(place: str, opener=None) -> str:
    if not place.lower().startswith(("http://", "https://")):
        return Path(place).read_text("utf-8-sig")
    from urllib.request import urlopen

    with (opener or urlopen)(place) as answer:
        return answer.read().decode("utf-8-sig")


def load_sets(place: str, opener=None) -> list[dict]:
    """The sets of a file or address: one set, a list of rules, a list of sets, or a manifest {"sets": [...]} of places relative to it."""
    text = _text(place, opener)
    name = place.rstrip("/").rsplit("/", 1)[-1].removesuffix(".json")
    try:
        got = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"{place}: line {e.lineno}, column {e.colno}: {e.msg}") from None
    if isinstance(got, dict) and "rules" not in got and isinstance(got.get("sets"), list):
        web = place.lower().startswith(("http://", "https://"))
        inside = [s for s in got["sets"] if not isinstance(s, str)]
        places = [urljoin(place, s) if web else str(Path(place).parent / s) for s in got["sets"] if isinstance(s, str)]
        return [validate_set(s) for s in inside] + [s for p in places for s in load_sets(p, opener)]
    if isinstance(got, list) and got and all(isinstance(s, dict) and "rules" in s for s in got):
        return [validate_set(s) for s in got]
    return [parse_set(text, name)]


def find_config(start: str = ".", name: str = CONFIG) -> str | None:
    """The configuration file in the folder or the nearest one above it."""
    here = Path(start).resolve()
    return next((str(p / name) for p in (here, *here.parents) if (p / name).is_file()), None)


def load_config(path: str | None) -> dict:
    """The configuration, empty where there is none."""
    if not path:
        return {}
    try:
        return json.loads(Path(path).read_text("utf-8-sig"))
    except (OSError, json.JSONDecodeError) as e:
        raise ValueError(f"{path} cannot be read: {e}") from None


# ------------------------------------------------------------------ snapshots


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(generated, word, rank) of files that hold a script's one object: the words of the component that leads.

    What is no such object, or of an older shape, has no rows.
    """
    return parsed_snapshots(spark.read.text(path, wholetext=True))


def parsed_snapshots(files: DataFrame) -> DataFrame:
    """The same of a table with the files' texts in the column value."""
    schema = "generated string, components array<struct<lead: boolean, word_list: array<string>>>"
    body = F.regexp_replace(F.regexp_extract("value", r"(?s)\{.*", 0), r"\s*;\s*\z", "")
    d = files.select(F.from_json(body, schema).alias("d"))
    lead = F.try_element_at(F.filter("d.components", lambda c: c["lead"]), F.lit(1))
    return d.select("d.generated", F.posexplode(lead["word_list"]).alias("at", "word")).select(F.to_date("generated").alias("generated"), "word", (F.col("at") + 1).alias("rank"))
