"""Detectors M1-M8: columns of occurrences. Neighbouring sentences meet inside their row, so no detector shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.needles import may_match
from ..functions.text import COMMON_OPENERS, ECHO_WORD, FUNCTION_WORDS, RATE_WORD, RUN_START, SENTENCE, java_pattern, let, matches, ngrams, occurrences

# What separates the items of a chain.
CHAIN_SEPARATOR = r"(?i)(?:\s*,\s*(?:and\s+|or\s+)?|\s+(?:and|or)\s+|\s*[;&–—]\s*(?:and\s+|or\s+)?|\s+-{1,2}\s+)"
QUESTIONS = RUN_START + r"[^.!?\n]++\?(?:\s+[^.!?\n]++\?)++"
# what a match begins with is looked for first, as most places fail at it
ABBREVIATION = r"(?=[DMPSJveaFNILC])(?<![A-Za-z0-9_])(Dr|Mr|Mrs|Ms|Prof|Sr|Jr|St|vs|etc|approx|Fig|No|Inc|Ltd|Co)\.(?=\s)"
CODE_MARK = r'[=\[\]{}|\\<>@#$~^*/]|::|[A-Za-z0-9_]_[A-Za-z0-9_]|"""|`'
# whether CODE_MARK is anywhere, asked without a look at letters
MARKED = r'(?=[=\[\]{}|\\<>@#$~^*/:_"`])(?:[^:_"]|::|(?<=[A-Za-z0-9_])_[A-Za-z0-9_]|""")'


def regex(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """M1: every non-overlapping match with its offsets."""
    return occurrences(text, java_pattern(pattern, ignore_case))


def counted(text: Column, lowered: Column, pattern: str) -> Column:
    """M1 for what needs the number alone: matches are looked for only where the lower-cased text holds a needle of the pattern."""
    n = F.regexp_count(text, F.lit(java_pattern(pattern)))
    possible = may_match(lowered, pattern)
    return n if possible is None else F.when(possible, n).otherwise(0)


def distinct_matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """M2: the different matches, lower-cased."""
    return F.array_distinct(F.transform(matches(text, java_pattern(pattern, ignore_case)), F.lower))


def vocabulary_hits(docs: DataFrame, words: DataFrame) -> DataFrame:
    """M2 for flat word lists: distinct listed words of each document, by a token join instead of an alternation.

    Tokens are maximal runs of ASCII word characters, so the result equals \\b(?:...)\\b for entries of such characters.
    """
    tokens = docs.select("doc_id", F.explode(F.array_distinct(matches(F.lower("text"), "[a-z0-9_]+"))).alias("word"))
    return tokens.join(words, "word").groupBy("doc_id").agg(F.count("*").alias("n_distinct"))


def chain(text: Column, pattern: str, head_test: str) -> Column:
    """M3: occurrences with the number of items whose head matches; trailing blanks are not part of one."""
    found = regex(text, pattern)
    test = java_pattern(head_test)

    def one(o: Column) -> Column:
        value = F.regexp_replace(o["value"], r"\s+\z", "")
        items = F.filter(F.split(o["value"], CHAIN_SEPARATOR, -1), lambda p: F.trim(p).rlike(test))
        return F.struct(o["start"].alias("start"), (o["start"] + F.length(value)).alias("stop"), value.alias("value"), F.size(items).alias("n"))

    return F.transform(found, one)


def question_chain(text: Column, min_run: int = 2) -> Column:
    """M5: runs of questions, without their leading blanks."""

    def one(o: Column) -> Column:
        value = F.regexp_replace(o["value"], r"^\s+", "")
        return F.struct((o["stop"] - F.length(value)).alias("start"), o["stop"].alias("stop"), value.alias("value"), F.regexp_count(value, F.lit(r"\?")).alias("n"))

    return F.filter(F.transform(occurrences(text, QUESTIONS), one), lambda o: o["n"] >= min_run)


def sentences(docs: DataFrame, kind: str, text: Column | None = None) -> DataFrame:
    """doc_id, pos, start, stop, value: one row per sentence of the given splitter."""
    found = occurrences(F.col("text") if text is None else text, SENTENCE[kind])
    return docs.select("doc_id", F.posexplode(found).alias("pos", "s")).select("doc_id", "pos", "s.start", "s.stop", "s.value")


def _runs(items: Column, linked, min_run: int, told) -> Column:
    """Gaps and islands inside a row: told(first item, last item, item before the last, number) of runs in which each item is linked(item, the one before) to its predecessor, at least min_run long."""

    def islands(s: Column) -> Column:
        # places at which a run begins; a run ends where the next one begins
        begins = F.filter(F.transform(s, lambda x, i: F.when(~F.coalesce(linked(x, F.get(s, i - 1)), F.lit(False)), i)), lambda i: i.isNotNull())
        spans = let(begins, lambda b: F.transform(b, lambda i, k: F.struct(i.alias("i"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).alias("n"))))
        return F.transform(F.filter(spans, lambda r: r["n"] >= min_run), lambda r: told(F.get(s, r["i"]), F.get(s, r["i"] + r["n"] - 1), F.get(s, r["i"] + r["n"] - 2), r["n"].cast("long")))

    return let(items, islands)


def _rows(docs: DataFrame, runs: Column) -> DataFrame:
    return docs.select("doc_id", F.inline(runs))


def echo_runs(text: Column, min_gram: int = 4, min_run: int = 2, anchored: str | None = None, min_function_words: int = 0, min_share: float = 0.0) -> Column:
    """M4: array<struct<start, stop, n, shared>> of runs of neighbouring sentences that share a word sequence."""
    long_ones = F.filter(occurrences(text, SENTENCE["echo"]), lambda o: F.regexp_count(o["value"], F.lit(r"\S+")) >= 4)

    def cut(o: Column) -> Column:
        return let(matches(F.lower(o["value"]), ECHO_WORD), lambda w: F.struct(o["start"].alias("start"), o["stop"].alias("stop"), o["value"].alias("value"), w.alias("words"), F.array_distinct(ngrams(w, min_gram)).alias("grams")))

    def head(x: Column) -> Column:
        return F.array_join(F.slice(x, 1, min_gram), " ")

    def tail(x: Column) -> Column:
        return F.array_join(F.slice(x, F.greatest(F.size(x) - min_gram + 1, F.lit(1)), min_gram), " ")

    def common(x: Column, before: Column) -> Column:
        mine, last = x["words"], before["words"]
        found = F.array_intersect(before["grams"], x["grams"])
        if anchored:
            options = []
            if anchored != "tail":
                options.append(F.when((head(last) == head(mine)) & (head(last) != ""), head(last)))
            if anchored != "head":
                options.append(F.when((tail(last) == tail(mine)) & (tail(last) != ""), tail(last)))
            found = F.filter(F.array(*options), lambda g: g.isNotNull())
        if min_function_words:
            found = F.filter(found, lambda g: F.size(F.filter(F.split(g, " "), lambda w: w.isin(FUNCTION_WORDS))) >= min_function_words)
        if min_share:
            shortest = F.greatest(F.least(F.size(last), F.size(mine)), F.lit(1))
            found = F.filter(found, lambda g: F.size(F.split(g, " ")) / shortest >= min_share)
        return found

    def told(first: Column, last: Column, before: Column, n: Column) -> Column:
        longest = F.aggregate(common(last, before), F.lit(""), lambda a, g: F.when(F.length(g) > F.length(a), g).otherwise(a))
        blanks = F.length(last["value"]) - F.length(F.regexp_replace(last["value"], r"\s+\z", ""))
        return F.struct(first["start"].alias("start"), (last["stop"] - blanks).alias("stop"), n.alias("n"), longest.alias("shared"))

    return _runs(F.transform(long_ones, cut), lambda x, before: (x["start"] - before["stop"] <= 3) & (F.size(common(x, before)) > 0), min_run, told)


def echo(docs: DataFrame, *parameters, **named) -> DataFrame:
    """M4 by row: doc_id, start, stop, n, shared."""
    return _rows(docs, echo_runs(F.col("text"), *parameters, **named))


def anaphora_runs(text: Column, min_run: int = 3) -> Column:
    """M6: array<struct<start, stop, n, head>> of neighbouring sentences with one opening word, common openers apart."""

    def opened(o: Column) -> Column:
        return let(F.regexp_extract(o["value"], r"[A-Za-z'’-]+", 0), lambda w: F.struct((o["start"] + F.instr(o["value"], w) - 1).alias("start"), o["stop"].alias("stop"), F.lower(w).alias("head")))

    items = F.filter(F.transform(occurrences(text, SENTENCE["anaphora"]), opened), lambda x: x["head"] != "")
    told = lambda first, last, _, n: F.struct(first["start"].alias("start"), last["stop"].alias("stop"), n.alias("n"), first["head"].alias("head"))
    runs = _runs(items, lambda x, before: (x["head"] == before["head"]) & (x["start"] - before["stop"] < 4), min_run, told)
    return F.filter(runs, lambda r: ~r["head"].isin(COMMON_OPENERS))


def anaphora(docs: DataFrame, min_run: int = 3) -> DataFrame:
    """M6 by row: doc_id, start, stop, n, head."""
    return _rows(docs, anaphora_runs(F.col("text"), min_run))


RUN = "struct<start: int, stop: int, n: long, sig: string>"


def frame_runs(text: Column, gram: int = 8, min_run: int = 3, anchors: int = 2, min_letters: int = 13, letter_ratio: float = 0.62) -> Column:
    """M7: array<struct<start, stop, n, sig>> of prose sentences in a row whose first tokens have one skeleton of function words and marks."""

    def trimmed(o: Column) -> Column:
        return let(F.ltrim(o["value"], F.lit(" \t\n\x0b\f\r")), lambda v: F.struct((o["stop"] - F.length(v)).alias("start"), o["stop"].alias("stop"), F.translate(v, "\0", ".").alias("value")))

    # what is no letter goes in runs: a list of every single one costs far more
    letters = lambda v, of: F.length(F.regexp_replace(v, f"[^{of}]+", ""))

    def prose(o: Column) -> Column:
        v = o["value"]
        # blanks one by one: the engine has a table for single characters, not for \s in a class
        return (v != "") & (letters(v, "A-Za-z") >= min_letters) & ~v.rlike(MARKED) & (letters(v, r"A-Za-z \t\n\x0B\f\r") / F.length(v) >= letter_ratio)

    def token(t: Column) -> Column:
        low = F.lower(t)
        return F.when(low == "an", "a").when(low.isin([*FUNCTION_WORDS, *',;:()"']), low).otherwise("_")

    def sig(v: Column) -> Column:
        tokens = F.transform(F.slice(matches(v, r"""[A-Za-z][A-Za-z'’-]*|[,;:()"]"""), 1, gram), token)
        enough = lambda g: F.when((F.size(g) >= gram) & (F.size(F.filter(g, lambda t: t != "_")) >= anchors), F.array_join(g, " "))
        return let(tokens, enough)

    def found(text: Column) -> Column:
        items = F.transform(F.filter(F.transform(occurrences(text, SENTENCE["frame"]), trimmed), prose), lambda o: F.struct(o["start"].alias("start"), o["stop"].alias("stop"), sig(o["value"]).alias("sig")))
        told = lambda first, last, _, n: F.struct(first["start"].alias("start"), last["stop"].alias("stop"), n.alias("n"), first["sig"].alias("sig"))
        return F.filter(_runs(items, lambda x, before: x["sig"] == before["sig"], min_run, told), lambda r: r["sig"].isNotNull())

    def repeated(text: Column) -> Column:
        """Whether one skeleton stands min_run times among all sentences, of prose or not: without that no run is there, and places and letters need not be found."""
        sigs = F.array_sort(F.filter(F.transform(matches(text, SENTENCE["frame"]), sig), lambda g: g.isNotNull()))
        return let(sigs, lambda s: F.exists(F.transform(s, lambda g, i: g == F.get(s, i + min_run - 1)), lambda x: x))

    nothing = F.expr(f"cast(array() as array<{RUN}>)")
    return let(F.regexp_replace(text, ABBREVIATION, "$1\0"), lambda t: F.when(F.coalesce(repeated(t), t.isNull()), found(t)).otherwise(nothing))


def frames(docs: DataFrame, *parameters, **named) -> DataFrame:
    """M7 by row: doc_id, start, stop, n, sig."""
    return _rows(docs, frame_runs(F.col("text"), *parameters, **named))


def rhythm(text: Column, shortest: int = 1, longest: int = 200) -> tuple[Column, Column]:
    """M8: (coefficient of variation of words per sentence, or null; number of sentences)."""
    lengths = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+", -1), lambda p: F.regexp_count(p, F.lit(RATE_WORD))), lambda n: n > 0)

    def told(lengths: Column) -> Column:
        total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)
        squares = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n.cast("long") * n)
        return F.struct(F.size(lengths).alias("n"), total.alias("total"), squares.alias("squares"))

    def value(s: Column) -> Column:
        n, total = s["n"], s["total"]
        # sd / mean = sqrt(n * squares - total^2) / total, whole numbers until the end
        cv = F.try_divide(F.sqrt((n * s["squares"] - total * total).cast("double")), total)
        return F.struct(F.when((n > 0) & F.try_divide(total, n).between(shortest, longest), cv).alias("value"), n.alias("n"))

    # bound by name: the words of a text are found once, whatever is asked of their numbers
    made = let(let(lengths, told), value)
    return made["value"], made["n"]
