"""Style and density metrics, and bands at percentiles of a corpus by mergeable quantile sketches.

A style set bounds six metrics from both sides. Where its bounds lie is measured: rates of every document are gathered
into one small sketch a register and metric, sketches of days or sources merge, and bands are read from them at any
percentile; no document is sorted or kept. Documents without a rate (no words, too few sentences for a rhythm) are left
out of the sketches.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules

# The style metrics and their patterns; a rate is per 1000 words, and the rhythm has no pattern.
STYLE = {
    "sentence-length": r"[.!?](?=\s|$)",
    "rhythm": None,
    "comma": ",",
    "second-person": r"\b(?:you|your|yours)\b",
    "nominalisation": r"\b\w{4,}(?:tion|ment|ity|ness)s?\b",
    "passive": r"\b(?:is|are|was|were|be|been)\s+\w+(?:ed|en)\b",
}
# The measured density metrics with their bounds per 1000 words. The patterns are ours where none is given.
DENSITY = {
    "commas": (",", {"<=": 20}),
    "parentheses": (r"\(", {"<=": 0}),
    "sentence-endings": (r"[.!?](?=\s|$)", {"<=": 20}),
    "nominalisations": (r"\b\w{4,}(?:tion|ment|ity|ness)s?\b", {">=": 70}),
    "tricolons": (r"\b\w+, \w+,? and \w+", {">=": 8}),
    "em-dashes": ("—", {">=": 35}),
}
#: A sketch of this size is off by a rank of 0.5 % at most (the published bound for k = 600, at 99 % confidence).
SIZE, OFF = 600, 0.005


def metric_rule(name: str, pattern: str | None, bounds: dict, needs: dict | None = None) -> dict:
    """A rule that reports a metric outside its bounds: per 1000 words, or as it is for the rhythm."""
    if pattern is None:
        return {"id": name, "match": {"kind": "rhythm"}, "notable": bounds | ({"needs": needs} if needs else {})}
    return {"id": name, "match": {"kind": "regex", "pattern": pattern, "flags": "i"}, "notable": bounds | {"per": 1000, "unit": "words"} | ({"needs": needs} if needs else {})}


def density_set(needs: dict | None = None) -> dict:
    return {"name": "density", "rules": [metric_rule(k, p, b, needs) for k, (p, b) in DENSITY.items()]}


#: The value of a metric whatever the length of its document.
FREE = {"words": 0, "sentences": 0, "functionWords": 0, "matches": 0}
MEASURED = [metric_rule(k, p, {">=": 0}, FREE) for k, p in STYLE.items()]


def style_rates(docs: DataFrame, *keep: str, metrics: Collection[str] = tuple(STYLE)) -> DataFrame:
    """(keep, metric, value) of the style metrics of each document (doc_id and keep columns, text), in one scan; null where there is none.

    metrics: those that are wanted. A filter on the rows comes too late: all counts of a document are one array.
    """
    keyed = docs.select(F.struct("doc_id", *keep).alias("doc_id"), "text")
    rows = rules.judged(keyed, rules.resolve([{"name": "measured", "rules": [r for r in MEASURED if r["id"] in metrics]}]))
    value = F.when(F.col("rate_words") > 0, F.col("value"))
    return rows.select("doc_id.doc_id", *(f"doc_id.{c}" for c in keep), F.col("rule").alias("metric"), value.alias("value"))


def sketches(rates: DataFrame, *by: str, size: int = SIZE) -> DataFrame:
    """(by, metric, n, sketch): a quantile sketch of the values of each metric; a few kilobytes each, whatever they hold."""
    held = rates.where(F.col("value").isNotNull())
    return held.groupBy(*by, "metric").agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col("value"), size).alias("sketch"))


def merged(parts: DataFrame, *by: str, size: int = SIZE) -> DataFrame:
    """Sketches of parts (days, sources) as those of the whole."""
    return parts.groupBy(*by, "metric").agg(F.sum("n").alias("n"), F.kll_merge_agg_double(F.col("sketch"), size).alias("sketch"))


def bands(held: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """held with lo and hi: the values at two ranks of each sketch."""
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))
    return held.withColumn("lo", at(low)).withColumn("hi", at(high)).drop("sketch")


def outside(rates: DataFrame, found: DataFrame, *by: str) -> DataFrame:
    """rates with the bound of their register's band that they cross: "<=" or ">=", null between them."""
    j = rates.join(found.select(*by, "metric", "lo", "hi"), [*by, "metric"])
    return j.withColumn("bound", F.when(F.col("value") >= F.col("hi"), ">=").when(F.col("value") <= F.col("lo"), "<="))


def style_set(name: str, found: list, needs: dict | None = None) -> dict:
    """A style set of the bands of one register: rows with metric, lo and hi."""
    return {"name": name, "role": "style", "rules": [metric_rule(r["metric"], STYLE[r["metric"]], {"<=": r["lo"], ">=": r["hi"]}, needs) for r in sorted(found, key=lambda r: r["metric"])]}
