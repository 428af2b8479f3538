"""The library of rule sets: reports R10, import R11, building R12, activation R13, installing and drift R9, lock K14.

A library is a folder on the driver with one JSON file per set and lock.json.
Sets are control data of a few kilobytes; documents are never read here.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .rules import compare_versions, conformance, content_hash, resolve, validate_set

LOCK = "lock.json"
RULE_ROW = "`set` string, rule string, kind string, severity string, active boolean, bounds string, description string, suggest string"
SET_ROW = "`set` string, version string, rules int, active int, sha256 string"


# ------------------------------------------------------------------ reports


def rule_rows(spark: SparkSession, sources: list[dict], **selection) -> DataFrame:
    """Every rule of the sets in force, with its state under the selection."""
    on = {(r["set"], r["id"]) for r in resolve(sources, **selection)}
    rows = []
    for s in resolve_sets(sources):
        for r in s["rules"]:
            bounds = " ".join(f"{op} {r['notable'][op]}" for op in (">", ">=", "<", "<=") if op in r["notable"])
            rows.append((s["name"], r["id"], r["match"]["kind"], r.get("severity", "warn"), (s["name"], r["id"]) in on, bounds, r.get("description"), r.get("suggest")))
    return spark.createDataFrame(rows, RULE_ROW)


def set_rows(spark: SparkSession, sources: list[dict], **selection) -> DataFrame:
    """One row per set with its version, size and content hash."""
    on = Counter(r["set"] for r in resolve(sources, **selection))
    return spark.createDataFrame([(s["name"], s.get("version"), len(s["rules"]), on[s["name"]], content_hash(s)) for s in resolve_sets(sources)], SET_ROW)


def resolve_sets(sources: list[dict]) -> list[dict]:
    """R2: the sets in force; the last of a name wins, and takes the last place."""
    by_name: dict[str, dict] = {}
    for s in sources:
        by_name.pop(s["name"], None)
        by_name[s["name"]] = validate_set(s)
    return list(by_name.values())


def explain(sources: list[dict], rule_id: str) -> dict:
    """One rule with the set it comes from, or ValueError."""
    found = [r | {"set": s["name"]} for s in resolve_sets(sources) for r in s["rules"] if r["id"] == rule_id]
    if not found:
        raise ValueError(f"no such rule: {rule_id}")
    return found[-1]


# ------------------------------------------------------------------ building


def word_list_rule(rule: dict, words: list[str], version: str) -> tuple[dict, str]:
    r"""The rule over \b(?:words)\b, and the version with its last part raised."""
    pattern = r"\b(?:" + "|".join(re.sub(r"[.*+?^${}()|\[\]\\]", r"\\\g<0>", w) for w in words) + r")\b"
    *head, last = version.split(".")
    return rule | {"match": rule["match"] | {"pattern": pattern}}, ".".join([*head, str(int(last) + 1)])


def import_rules(upstream: list[dict], overrides: dict | None = None, suggest: dict | None = None, notes: dict | None = None) -> tuple[list[dict], Counter]:
    """Upstream rules with overrides, suggestions and notes by id, and how many rules each kind has."""
    by_id = {r["id"] for r in upstream}
    unknown = sorted({k for part in (overrides, suggest, notes) for k in part or {}} - by_id)
    if unknown:
        raise ValueError(f"no such rule upstream: {', '.join(unknown)}")
    out = []
    for r in upstream:
        i = r["id"]
        r = r | (overrides or {}).get(i, {})
        r |= {k: part[i] for k, part in (("suggest", suggest), ("note", notes)) if part and i in part}
        out.append(r)
    return out, Counter(r["match"]["kind"] for r in out)


# ------------------------------------------------------------------ the installed library


def read_lock(folder: str) -> dict:
    path = Path(folder, LOCK)
    return json.loads(path.read_text("utf-8")) if path.exists() else {"sets": {}}


def write_lock(lock: dict, folder: str) -> None:
    """The lock with its sets in order of name."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    ordered = lock | {"sets": {k: lock["sets"][k] for k in sorted(lock["sets"])}}
    Path(folder, LOCK).write_text(json.dumps(ordered, indent=2, ensure_ascii=False) + "\n", "utf-8")


def inspect(rule_set: dict | list, spark: SparkSession | None = None) -> dict:
    """Name, version, rules, sha256 and, given a session, how many of the set's own examples fail."""
    s = validate_set(rule_set)
    failing = 0
    if spark is not None:
        failing = sum(r["n"] - r["passed"] for r in conformance(spark, s["rules"]).collect())
    return {"name": s["name"], "version": s.get("version", "0.0.0"), "rules": len(s["rules"]), "sha256": content_hash(s), "failing": failing}


def _file(folder: str, name: str) -> Path:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name) or f"{name}.json" == LOCK:
        raise ValueError(f"not a name for a set: {name!r}")
    return Path(folder, f"{name}.json")


def install(rule_set: dict, source: str, folder: str, day: str, spark: SparkSession | None = None, force: bool = False) -> dict:
    """Write the set and its lock entry; a set that fails its own examples is held back unless forced."""
    info = inspect(rule_set, spark)
    if info["failing"] and not force:
        raise ValueError(f"set {info['name']}: {info['failing']} of its examples fail")
    path = _file(folder, info["name"])
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(rule_set, indent=2, ensure_ascii=False) + "\n", "utf-8")
    lock = read_lock(folder)
    lock["sets"][info["name"]] = {"version": info["version"], "source": source, "rules": info["rules"], "sha256": info["sha256"], "tests": f"{info['failing']} failing" if info["failing"] else "pass", "installed": day}
    write_lock(lock, folder)
    return info


def uninstall(name: str, folder: str) -> bool:
    """Drop a set and its lock entry; False where it is not installed."""
    path = _file(folder, name)
    if not path.exists():
        return False
    path.unlink()
    lock = read_lock(folder)
    lock["sets"].pop(name, None)
    write_lock(lock, folder)
    return True


def installed(folder: str) -> list[dict]:
    """The sets of a library in order of name."""
    return [json.loads(p.read_text("utf-8")) for p in sorted(Path(folder).glob("*.json")) if p.name not in (LOCK, "index.json")]


def drift(folder: str, fetched: list[dict] | None = None) -> list[tuple[str, str]]:
    """(set, state) of a full outer join of the lock with the files, or with sets fetched from their sources.

    States: same, changed (another hash), newer, older (another version), missing (in the lock alone), unlocked.
    """
    lock = read_lock(folder)["sets"]
    now = {s["name"]: s for s in (installed(folder) if fetched is None else fetched)}
    out = []
    for name in sorted({*lock, *now}):
        if name not in now or name not in lock:
            out.append((name, "missing" if name not in now else "unlocked"))
            continue
        order = compare_versions(now[name].get("version", "0.0.0"), lock[name]["version"])
        out.append((name, {1: "newer", -1: "older"}.get(order) or ("same" if content_hash(now[name]) == lock[name]["sha256"] else "changed")))
    return out


def restore(folder: str, fetch, day: str, spark: SparkSession | None = None, force: bool = False) -> list[tuple[str, str]]:
    """Install what the lock names and the folder lacks; fetch(source) gives a set. (set, outcome) of each.

    A set whose content differs from the lock is held back unless forced.
    """
    out = []
    have = {s["name"] for s in installed(folder)}
    for name, entry in read_lock(folder)["sets"].items():
        if name in have:
            continue
        s = fetch(entry["source"])
        if content_hash(s) != entry["sha256"] and not force:
            out.append((name, "held back"))
            continue
        install(s, entry["source"], folder, day, spark, force)
        out.append((name, "restored"))
    return out
