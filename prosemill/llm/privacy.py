"""Personal data: pattern spans and information-theoretic sanitisation, in DataFrame operations alone.

Patterns find e-mail addresses, IP addresses, card numbers (Luhn) and telephone
numbers. Their values are the protected entities. A term (a whole word outside
the entities) discloses an entity of its document by
log2 P(entity | term) / P(entity); the counts of both, of either and of all are
documents, and copies count as documents in each of them. Terms above the
disclosure thresholds become spans as well, wherever they stand; sanitise()
generalises spans to their kind or removes them.

Offsets are code points, ends exclusive. Look-behinds and possessive repeats
keep every pattern linear in long runs without changing its matches; \\G lets a
match start where the last one ended.

Defined results: null and empty texts have no spans; a term needs three different
texts with the entity, so copies alone prove nothing; equal spans of one kind
cannot occur; repeated rows, repeated ids and null ids are rows of their own,
whose term spans follow their texts; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, let, occurrences
from ..operators.analyze import cut, pieces_of
from .common import saved

# The patterns of the four kinds, in the order in which they are listed.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
TERM = r"\p{L}+"
SPAN = "array<struct<start: int, stop: int, value: string>>"


def located(text: str, pattern: Column) -> Column:
    """All matches in the text column, in order, with their offsets (0-based, end exclusive)."""
    return occurrences(F.col(text), pattern)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = _digits(x)
    n = F.length(d)

    def value(i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        twice = v * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return n.between(13, 19) & _luhn(x)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _check(kind: str):
    return lambda s: _valid(kind, s["value"])


def _entity(kind: str) -> Column:
    """The kind's spans with the protected value."""
    value = {"email": F.lower, "ip": lambda x: x}.get(kind, _digits)
    return F.transform(f"s_{kind}", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.concat(F.lit(kind + ":"), value(s["value"])).alias("entity")))


def _mark(kind: str, mark: str) -> Column:
    return F.transform(f"s_{kind}", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("last"), F.lit(mark).alias("mark")))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column of spans for each kind."""
    for kind, pattern in KINDS.items():
        has = F.contains(F.col(text), F.lit(NEEDS[kind])) if kind in NEEDS else F.col(text).rlike("[0-9]")
        found = F.filter(located(text, F.lit(pattern)), _check(kind))
        docs = docs.withColumn(f"s_{kind}", F.coalesce(F.when(has & F.col(text).rlike(pattern), found), F.expr(f"cast(array() as {SPAN})")))
    return docs


def _cleared(spans: Column) -> Column:
    """The text with each span replaced by its mark; of overlapping spans the first, then the longest, counts."""
    kind = "struct<start: int, last: int, mark: string>"

    def step(a: Column, x: Column) -> Column:
        clear = x["start"] >= a["at"]
        return F.when(clear, F.struct((-x["last"]).alias("at"), F.array_append(a["out"], x).alias("out"))).otherwise(a)

    def joined(text: Column, kept: Column) -> Column:
        # what lies before each span, and its mark; the text is cut by its pieces, so that no cut walks through it
        gaps = F.transform(kept, lambda x, i: F.concat(cut(text["pieces"], F.coalesce(-F.get(kept, i - 1)["last"], F.lit(0)), x["start"]), x["mark"]))
        return F.concat(F.array_join(gaps, ""), cut(text["pieces"], F.coalesce(-F.try_element_at(kept, F.lit(-1))["last"], F.lit(0)), text["n"]))

    kept = fold(F.array_sort(spans), F.lit(0), kind, step)
    return let(F.struct(pieces_of(F.col("text")).alias("pieces"), F.length("text").alias("n")), lambda text: let(kept, lambda k: joined(text, k)))


def _terms() -> Column:
    """The different words of a text outside its spans, lower-cased."""
    any_span = F.expr(" + ".join(f"size(s_{k})" for k in KINDS)) > 0
    outside = F.when(any_span, _cleared(F.concat(*(_mark(k, " ") for k in KINDS)))).otherwise(F.col("text"))
    return F.array_distinct(F.regexp_extract_all(F.lower(outside), F.lit(TERM), F.lit(0)))


def _small(words: DataFrame, most: int) -> tuple[DataFrame, int]:
    """words, to be broadcast if they are few, and their number."""
    n = words.count()
    return (F.broadcast(words) if n <= most else words), n


def disclosing_terms(spanned: DataFrame, least: int = 3, share: float = 0.5, bits: float = 6.0, max_broadcast: int = 50_000) -> DataFrame:
    """Terms above the thresholds: term, entity, bits.

    Candidates are judged first by the documents with an entity that can have terms. A term's documents there are
    no more than its documents in all, so that what fails there fails, and the rest is few enough to count in all.
    """
    any_span = F.expr(" + ".join(f"size(s_{k})" for k in KINDS)) > 0
    words = _terms()
    found = F.array_distinct(F.transform(F.concat(*map(_entity, KINDS)), lambda s: s["entity"]))
    total = spanned.count()
    enough = lambda both, term: (F.col(both) >= share * F.col(term)) & (F.log2(F.col(both) * F.lit(float(total)) / (F.col(term) * F.col("n_entity"))) >= bits)
    # each distinct text once, with its number of copies
    texts = spanned.where(any_span).select("t", found.alias("entities"), words.alias("terms"))
    texts = saved(texts.groupBy("t").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms")), "entity-texts")
    each = texts.select("t", "copies", F.explode("entities").alias("entity"))
    # n_both is at most n_term and n_entity, so neither may be too frequent for the bits
    seen = each.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_entity")).where((F.col("texts") >= least) & (F.log2(F.lit(float(total)) / F.col("n_entity")) >= bits))
    each = saved(each.join(seen.select("entity", "n_entity"), "entity"), "text-entities")
    held = texts.join(each.groupBy("t").agg(F.max("n_entity").alias("most")), "t").select("t", "copies", "most", F.explode("terms").alias("term"))
    common = held.groupBy("term").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_some"), F.max("most").alias("most"))
    common = common.where((F.col("texts") >= least) & (F.log2(F.lit(float(total)) / F.col("n_some")) >= bits) & (F.col("most") >= share * F.col("n_some"))).select("term", "n_some")
    held = saved(held.where(F.col("most") >= share * F.col("copies")).join(common, "term").select("t", "term", "n_some"), "text-terms")
    pairs = each.join(held, "t").where(F.col("n_entity") >= share * F.col("n_some")).groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_some").alias("n_some"))
    pairs = saved(pairs.where((F.col("texts") >= least) & enough("n_both", "n_some")).drop("texts", "n_some"), "entity-terms")
    candidates, n = _small(pairs.select("term").distinct(), max_broadcast)
    each = spanned.select(F.explode(words).alias("term"))
    # many candidates meet the counts of all terms, which are added up where they are first
    counts = each.join(candidates, "term").groupBy("term").agg(F.count("*").alias("n_term")) if n <= max_broadcast else each.groupBy("term").agg(F.count("*").alias("n_term"))
    terms = pairs.join(counts, "term").where(enough("n_both", "n_term"))
    bits_of = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    return saved(terms.select("term", "entity", bits_of.alias("bits")), "disclosing-terms")


def find_private(docs: DataFrame, max_broadcast: int = 50_000, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """doc_id, text and span columns s_email, s_ip, s_card, s_phone, s_term."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # a text's terms are its own, whatever the id: texts are known by their hash
    spanned = base_spans(slim.withColumn("t", F.xxhash64("text")))
    listed, n_listed = _small(disclosing_terms(spanned, max_broadcast=max_broadcast, **thresholds).select("term").distinct(), max_broadcast)
    if not n_listed:
        return spanned.drop("t").withColumn("s_term", F.expr(f"cast(array() as {SPAN})"))
    # only texts that hold a disclosing term are shuffled
    of = spanned.select("t", F.explode(_terms()).alias("term")).join(listed, "term").groupBy("t").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    of = saved(of, "texts-with-terms")
    n = of.count()
    joined = spanned.join(F.broadcast(of) if n <= max_broadcast else of, "t", "left")
    # terms hold letters only, so they need no quoting; the longest alternative comes first
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    return joined.withColumn("s_term", F.coalesce(F.when(F.col("terms").isNotNull(), located("text", pattern)), F.expr(f"cast(array() as {SPAN})"))).drop("terms", "t")


def span_list(kinds: list[str]) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, joined by commas."""
    one = lambda k: F.transform(f"s_{k}", lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["stop"].cast("string")))
    return F.concat_ws(",", *(one(k) for k in kinds))


def sanitise(found: DataFrame, remove: bool = False) -> DataFrame:
    """doc_id and the text with each span generalised to [KIND] (or removed); of overlapping spans the first, then the longest, counts."""
    every = F.concat(*(_mark(k, "" if remove else f"[{k.upper()}]") for k in [*KINDS, "term"]))
    return found.select("doc_id", _cleared(every).alias("text"))
