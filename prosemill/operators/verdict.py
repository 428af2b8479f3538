"""Verdicts V1-V9: from counts, or a metric, to a judged document."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FUNCTION_WORDS, let, words_of


@dataclass(frozen=True)
class Notable:
    """When a count is worth reporting. bounds: by operator; per or power: the normalisation, at most one of them."""

    bounds: dict[str, float]
    per: float | None = None
    power: float | None = None
    metric: bool = False
    needs: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        if not self.bounds or set(self.bounds) - {">", ">=", "<", "<="}:
            raise ValueError("notable needs bounds among > >= < <=")
        if self.per is not None and self.power is not None:
            raise ValueError("per and power exclude each other")
        if isinstance(self.per, str) or (self.power is not None and not 0 < self.power <= 1):
            raise ValueError("per is a number; power is above 0 and at most 1")

    def gate(self, name: str) -> float:
        normalised = self.per is not None or self.power is not None
        defaults = {"words": 250, "sentences": 5, "function_words": 0.12, "matches": 0} if normalised and not self.metric else {}
        return self.needs.get(name, defaults.get(name, 0))

    def tuned(self, **changes) -> "Notable":
        """V9: other thresholds for the same rule."""
        return Notable(**(self.__dict__ | changes))


def doc_stats(docs: DataFrame) -> DataFrame:
    """docs with ws_words, rate_words, gate_sentences and fn_words, computed once for all rules (V6, V7). Words are found once for their number and for those of function."""
    counted = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), F.size(F.filter(w, lambda x: F.lower(x).isin(FUNCTION_WORDS))).alias("fn")))
    rows = docs.withColumns(
        {
            "ws_words": F.regexp_count("text", F.lit(r"\S+")).cast("long"),
            "words_": counted,
            "gate_sentences": F.regexp_count("text", F.lit(r"[.!?](?=\s|\z)")).cast("long"),
        }
    )
    return rows.select(*(c for c in rows.columns if c not in ("words_", "gate_sentences")), F.col("words_.n").cast("long").alias("rate_words"), "gate_sentences", F.col("words_.fn").cast("long").alias("fn_words"))


def value_of(n: Column, notable: Notable) -> Column:
    """V2-V5: the count, its rate, its power-normalised value, or the metric itself."""
    words = F.col("rate_words")
    if notable.metric:
        return n
    if notable.power is not None:
        return F.when(words > 0, n / F.pow(words.cast("double"), F.lit(notable.power))).otherwise(0.0)
    if notable.per is not None:
        return F.when(words > 0, n / words * notable.per).otherwise(0.0)
    return n.cast("double")


def crossed(value: Column, notable: Notable) -> Column:
    """V1: the first bound crossed, in the order > >= < <=."""
    tests = {">": value.__gt__, ">=": value.__ge__, "<": value.__lt__, "<=": value.__le__}
    return F.coalesce(*(F.when(tests[op](notable.bounds[op]), op) for op in (">", ">=", "<", "<=") if op in notable.bounds), F.lit(None).cast("string"))


def gates(notable: Notable, n: Column | None = None) -> Column:
    """V6: enough words, sentences, function words and matches to be judged."""
    share = F.when(F.col("rate_words") > 0, F.col("fn_words") / F.col("rate_words")).otherwise(0.0)
    ok = (F.col("rate_words") >= notable.gate("words")) & (F.col("gate_sentences") >= notable.gate("sentences")) & (share >= notable.gate("function_words"))
    return ok if n is None else ok & (n >= notable.gate("matches"))


def judge(rows: DataFrame, n: Column, notable: Notable) -> DataFrame:
    """rows (with doc_stats) with value, bound and fires."""
    v = value_of(n, notable)
    ok = gates(notable, None if notable.metric else n)
    return rows.withColumn("value", v).withColumn("bound", F.when(ok & v.isNotNull(), crossed(v, notable))).withColumn("fires", F.col("bound").isNotNull())


def shown(v: Column) -> Column:
    """V8: whole numbers from ten on, else two decimals."""
    return F.when(v >= 10, F.floor(v + 0.5)).otherwise(F.floor(v * 100 + 0.5) / 100)
