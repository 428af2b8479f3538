"""Quality rules: fixed counts, and divergence of a document from its language's reference.

Pass 1 counts, for each whole text, the base figures, a histogram of character
classes and a histogram of common function words. All documents of a language
make its reference. A document's verdict is the Jensen-Shannon distance (base 2,
0 to 1) of its two histograms to the reference, judged only from a minimum
length on.

Defined results: null text counts as empty (no words, so base_failed); null or
unknown languages share one reference; documents below the minimum length pass
the divergence rules; repeated rows and ids are judged one by one; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, saved, word_hashes

# Frequent function words of four languages.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son leur".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como sus le ha me si sin sobre este ya".split(),
}
WORDS = sorted({w for v in COMMON.values() for w in v})
CLASSES = ("lower", "upper", "digit", "blank", "line", "comma_stop", "other_mark", "symbol", "other_letter", "rest")


def _class_table() -> np.ndarray:
    """Class of each UTF-8 byte; a non-ASCII character counts once, by its first byte."""
    t = np.full(256, len(CLASSES), np.uint8)  # continuation bytes: no class
    for b in range(128):
        c = chr(b)
        name = "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "blank" if c in " \t" else "line" if c in "\n\r" else "comma_stop" if c in ",." else "symbol" if c in "#*$%&|<>" else "other_mark" if b > 32 else "rest"
        t[b] = CLASSES.index(name)
    t[0xC2:0xE0] = CLASSES.index("other_letter")
    t[0xE0:0xF5] = CLASSES.index("rest")
    return t


SYMBOL = re.compile(rb"[#*$%&|<>]")


def figures(text: str | None, table: np.ndarray, common: dict, cache: dict, window: int = 5):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class histogram, word histogram)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    kinds = np.frombuffer(raw, np.uint8)
    classes = np.bincount(table[kinds], minlength=len(CLASSES) + 1)[: len(CLASSES)]
    joined = np.frombuffer(b"".join(words), np.uint8)
    word_chars = int(((joined & 0xC0) != 0x80).sum())
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    repeat = 0
    if n > window:
        h = word_hashes(words, cache)
        k = np.zeros(n - window + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(window):
                k = (k ^ h[j : j + len(k)]) * np.uint64(0x9E3779B97F4A7C15)
                k ^= k >> np.uint64(29)
        order = np.argsort(k, kind="stable")
        same = k[order][1:] == k[order][:-1]
        if same.any():
            hit = np.zeros(len(k), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            cover = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(hit)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            repeat = int((np.cumsum(cover)[:n] > 0).sum())
    seen = np.zeros(len(WORDS) + 1, np.int64)
    found = [common[w] for w in raw.lower().split() if w in common]
    seen[: len(WORDS)] = np.bincount(found, minlength=len(WORDS)) if found else 0
    seen[-1] = n - len(found)
    return n, word_chars, len(SYMBOL.findall(raw)), len(lines) - len(set(lines)), repeat, classes, seen


def _js(p: str, q: str) -> str:
    """SQL: Jensen-Shannon distance of two histograms as arrays of counts; 0 where one is empty."""
    total = lambda x: f"aggregate({x}, 0D, (a, v) -> a + v)"
    norm = lambda x: f"transform({x}, v -> v / nullif({total(x)}, 0D))"
    term = "if(x > 0, x * log2(2 * x / (x + y)), 0D) + if(y > 0, y * log2(2 * y / (x + y)), 0D)"
    return f"sqrt(greatest(0D, aggregate(zip_with({norm(p)}, {norm(q)}, (x, y) -> {term}), 0D, (a, v) -> a + v) / 2))"


def quality_rules(docs: DataFrame, max_class_distance: float = 0.30, max_word_distance: float = 0.55, min_words: int = 50, max_languages: int = 10_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the base figures, base_failed, class_distance, word_distance and kept."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        kinds, common, cache = _class_table(), {w.encode(): i for i, w in enumerate(WORDS)}, held("words", dict)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                rows = [figures(t, kinds, common, cache) for t in part.column(2).to_pylist()]
                ints = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
                hists = [pa.array([r[k].tolist() for r in rows], pa.list_(pa.int64())) for k in (5, 6)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *ints, *hists], ["doc_id", "lang", *names, "classes", "commons"])

    counted = saved(slim.mapInArrow(run, "doc_id long, lang string, " + ", ".join(f"{n} long" for n in names) + ", classes array<long>, commons array<long>"), "quality-counts")
    long = counted.where(f"n_words >= {min_words}").select("lang", F.posexplode(F.concat("classes", "commons")).alias("pos", "v")).groupBy("lang", "pos").agg(F.sum("v").alias("v"))
    k = len(CLASSES)
    reference = long.groupBy("lang").agg(F.expr("transform(array_sort(collect_list(struct(pos, v))), x -> x.v)").alias("all")).select("lang", F.expr(f"slice(all, 1, {k})").alias("ref_classes"), F.expr(f"slice(all, {k + 1}, {len(WORDS) + 1})").alias("ref_commons"))
    reference = saved(reference, "quality-reference")
    if reference.count() <= max_languages:  # one short row a language: below 10 MB here, so a broadcast is safe
        reference = F.broadcast(reference)
    j = counted.join(reference, "lang", "left")
    j = j.withColumn("class_distance", F.expr(_js("classes", "ref_classes"))).withColumn("word_distance", F.expr(_js("commons", "ref_commons")))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = (F.col("n_words") >= min_words) & ((F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance))
    return j.select("doc_id", *names, base.alias("base_failed"), "class_distance", "word_distance", (~base & ~far).alias("kept"))
