"""Combination A2-A9: overlap collapse, findings, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, let
from .spans import claimed


def collapse(found: DataFrame, *more: str) -> DataFrame:
    """A3: of overlapping spans of a document the leftmost, then longest, then first rule survives; doc-level ones stay.

    found: doc_id, rule, rule_ord, start, stop, doc_level and the columns `more`, which go along. A fold over each
    document's sorted spans, as what is dropped depends on the last one kept.
    """
    one = F.struct("start", (-F.col("stop")).alias("neg"), "rule_ord", "doc_level", "rule", *more)
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(one), lambda a, b: _order(a, b)).alias("s"))
    kept = spans.select("doc_id", F.explode(not_overlapped(F.col("s"), spans.schema["s"].dataType.elementType.simpleString())).alias("k"))
    return kept.select("doc_id", "k.rule", "k.rule_ord", "k.start", (-F.col("k.neg")).alias("stop"), "k.doc_level", *(f"k.{c}" for c in more))


def not_overlapped(spans: Column, kind: str) -> Column:
    """Of sorted array<kind> with start, neg (minus stop) and doc_level, those that begin behind the last one kept, and all doc-level ones."""

    def step(a: Column, x: Column) -> Column:
        kept = F.struct(F.when(x["doc_level"], a["at"]).otherwise(-x["neg"]).cast("int").alias("at"), F.array_append(a["out"], x).alias("out"))
        return F.when(~x["doc_level"] & (x["start"] < a["at"]), a).otherwise(kept)

    return fold(spans, F.lit(-1), kind, step)


def _order(a: Column, b: Column) -> Column:
    """By start, then longest, then rule; the other fields need not be comparable."""
    cases = F.lit(0)
    for c in ("rule_ord", "neg", "start"):
        cases = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(cases)
    return cases


def schedule(rows: DataFrame, ranges: str, priorities: int = 2) -> DataFrame:
    """Rows with a column array<struct<priority, start, stop>> cut to those that overlap nothing kept before, in reading order.

    Priorities run from 0. Territory is claimed by priority, then start, then length.
    """
    return rows.withColumn(ranges, claimed(F.col(ranges), priorities))


def split_by_line(table: Column, text: Column, kept: Column, keep_blank: bool = False) -> Column:
    """array<struct<line, start, stop, priority>>: ranges in order, cut at the ends of lines; parts in blank lines go unless kept."""

    ink = lambda x: F.rlike(x, F.lit(r"\S"))

    def line_of(start: Column) -> Column:
        """The whole line in which an offset lies."""
        return F.substring_index(F.substring(text, start - place(table, start, "col")["col"] + 2, F.length(text)), "\n", 1)

    def one(line: Column, start: Column, stop: Column, r: Column) -> Column:
        return F.struct(line.alias("line"), start.alias("start"), stop.alias("stop"), r["priority"].alias("priority"))

    def several(r: Column, x: Column) -> Column:
        pieces = F.split(x, "\n", -1)
        step = lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.array_append(a["out"], F.struct(a["at"].alias("start"), (a["at"] + F.length(x)).alias("stop"), ink(x).alias("ink"))).alias("out"))
        made = fold(pieces, r["start"], "struct<start: int, stop: int, ink: boolean>", step)
        kept = lambda made: F.transform(made, lambda x, i: F.when((x["stop"] > x["start"]) & (F.lit(keep_blank) | x["ink"] | ink(line_of(x["start"]))), i))
        told = lambda made, line: F.transform(F.array_compact(kept(made)), lambda i: one(line + i, F.get(made, i)["start"], F.get(made, i)["stop"], r))
        return let(made, lambda made: told(made, place(table, r["start"], "line")["line"]))

    def parts(r: Column) -> Column:
        nothing = F.expr("cast(array() as array<struct<line: int, start: int, stop: int, priority: int>>)")
        single = lambda x: F.when((r["stop"] > r["start"]) & (F.lit(keep_blank) | ink(x) | ink(line_of(r["start"]))), F.array(one(place(table, r["start"], "line")["line"], r["start"], r["stop"], r))).otherwise(nothing)
        # most ranges lie in one line, which needs no fold
        return let(cut(table, r["start"], r["stop"]), lambda x: F.when(F.contains(x, F.lit("\n")), several(r, x)).otherwise(single(x)))

    return F.flatten(F.transform(kept, parts))


#: Characters in a piece of a text's table.
WIDTH = 256


def pieces_of(text: Column) -> Column:
    """array<struct<s, base, n>>: a text in pieces of WIDTH characters, one at least, each with its first offset and length."""
    pieces = F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WIDTH}}}"), F.lit(0)))
    return F.transform(pieces, lambda x, i: F.struct(x.alias("s"), (i * WIDTH).alias("base"), F.length(x).alias("n")))


def place_table(text: Column) -> Column:
    """A text in pieces of WIDTH characters, by which any place is found without walking through the text.

    Each piece has what is known at its start: the newlines before it, where its line and its sentence begin, and
    where the next terminator lies; t is the piece with terminators turned to newlines, so that the last one is found
    from the right. Two folds over the pieces make it; bind it with let() and use it for all places.
    """
    plain = F.transform(pieces_of(text), lambda x: F.struct(x["s"].alias("s"), F.translate(x["s"], ".!?…", "\n\n\n\n").alias("t"), x["base"].alias("base"), x["n"].alias("n")))

    def after(x: Column, value: Column, before: Column) -> Column:
        return F.when(F.contains(value, F.lit("\n")), x["base"] + x["n"] - F.length(F.substring_index(value, "\n", -1))).otherwise(before)

    def forward(a: Column, x: Column) -> Column:
        at, newlines = a["at"], x["n"] - F.length(F.replace(x["s"], F.lit("\n"), F.lit("")))
        then = F.struct((at["lines"] + newlines).alias("lines"), after(x, x["s"], at["line"]).alias("line"), after(x, x["t"], at["sentence"]).alias("sentence"))
        return F.struct(then.alias("at"), F.array_append(a["out"], at).alias("out"))

    def backward(a: Column, x: Column) -> Column:
        here = F.when(F.contains(x["t"], F.lit("\n")), x["base"] + F.length(F.substring_index(x["t"], "\n", 1))).otherwise(a["at"])
        return let(here, lambda h: F.struct(h.alias("at"), F.array_append(a["out"], h).alias("out")))

    def table(p: Column) -> Column:
        state = "struct<lines: int, line: int, sentence: int>"
        starts = fold(p, F.struct(*(F.lit(0).alias(c) for c in ("lines", "line", "sentence"))), state, forward, state)
        ends = F.reverse(fold(F.reverse(p), F.length(text), "int", backward))
        known = F.zip_with(starts, ends, lambda x, e: F.struct(x["lines"].alias("lines"), x["line"].alias("line"), x["sentence"].alias("sentence"), e.alias("ends")))
        return F.zip_with(p, known, lambda x, k: F.struct(x["s"].alias("s"), x["t"].alias("t"), *(k[c].alias(c) for c in ("lines", "line", "sentence", "ends"))))

    return let(plain, table)


PLACE = ("line", "col", "sentence", "ends")


def place(table: Column, offset: Column, *fields: str) -> Column:
    """struct<line, col, sentence, ends> of an offset, by the text's place_table(), or of those fields that are named.

    X9: 1-based line and column. X10: where the sentence that holds the offset begins, and where the first terminator at
    or after it lies. The end of the text is a place in the last piece.
    """
    newline = F.lit("\n")

    def told(i: Column) -> Column:
        # the number alone is bound: a piece would be copied
        p, base, near = F.get(table, i), i * WIDTH, offset - i * WIDTH
        s, t = F.left(p["s"], near), F.left(p["t"], near)
        rest = F.substring(p["t"], near + 1, F.lit(WIDTH))
        made = {
            "line": (p["lines"] + near - F.length(F.replace(s, newline, F.lit(""))) + 1).cast("int"),
            "col": (F.when(F.contains(s, newline), F.length(F.substring_index(s, "\n", -1))).otherwise(offset - p["line"]) + 1).cast("int"),
            "sentence": F.when(F.contains(t, newline), offset - F.length(F.substring_index(t, "\n", -1))).otherwise(p["sentence"]),
            "ends": F.when(F.contains(rest, newline), offset + F.length(F.substring_index(rest, "\n", 1))).otherwise(F.coalesce(F.get(table, i + 1)["ends"], base + F.length(p["s"]))),
        }
        return F.struct(*(made[c].alias(c) for c in fields or PLACE))

    return let(F.least(F.floor(offset / WIDTH).cast("int"), F.size(table) - 1), told)


def cut(table: Column, start: Column, stop: Column) -> Column:
    """The text between two offsets, by its place_table() or pieces_of()."""
    first, last = F.floor(start / WIDTH).cast("int"), F.floor((stop - 1) / WIDTH).cast("int")
    from_, n = start - first * WIDTH + 1, stop - start
    several = F.array_join(F.transform(F.slice(table, first + 1, F.greatest(last - first + 1, F.lit(0))), lambda p: p["s"]), "")
    return F.when(stop <= start, "").when(first == last, F.substring(F.get(table, first)["s"], from_, n)).otherwise(F.substring(several, from_, n))


def sentence_around(table: Column, length: Column, start: Column, begins: Column, ends: Column) -> Column:
    """struct<body, text>: from the last terminator before the span, without leading blanks, to the first one after it with its closing marks, or to the end of the line.

    begins: the sentence of place(start); ends: the ends of place(stop), start and stop being the span's. body is the
    text from begins to ends, which holds the span.
    """

    def closing(most: Column, *wider: Column) -> Column:
        """The terminator and its closing marks; a run that fills what was looked at is looked for in more."""
        near = F.regexp_extract(cut(table, ends, most), r"""^[.!?…]["'”’)\]]*""", 0)
        return let(near, lambda m: F.when(F.length(m) < most - ends, m).otherwise(closing(*wider))) if wider else near

    def short(two: Column) -> Column:
        """The terminator alone, where what follows it is no closing mark: told without a search."""
        first, second = F.left(two, F.lit(1)), F.substring(two, 2, 1)
        return F.when((second == "") | F.contains(F.lit("\"'”’)]"), second), closing(F.least(ends + 8, length), F.least(ends + WIDTH, length), length)).when(F.contains(F.lit(".!?…"), first), first).otherwise("")

    def told(body: Column) -> Column:
        head = F.ltrim(F.left(body, start - begins), F.lit(" \t\n\x0b\f\r"))
        after = let(cut(table, ends, F.least(ends + 2, length)), short)
        return F.struct(body.alias("body"), F.concat(head, F.substring(body, start - begins + 1, ends - start), after).alias("text"))

    return let(cut(table, begins, ends), told)


def window_around(table: Column, length: Column, start: Column, stop: Column, width: int = 34) -> Column:
    """X11: the span with up to `width` characters on each side."""
    lo, hi = F.greatest(start - width, F.lit(0)), F.least(stop + width, length)
    body = F.trim(F.regexp_replace(cut(table, lo, hi), r"\s+", " "))
    return F.concat(F.when(lo > 0, "…").otherwise(""), body, F.when(hi < length, "…").otherwise(""))


def totals(found: DataFrame, stats: DataFrame) -> DataFrame:
    """A5: findings, whitespace words and findings per 1000 words of all documents."""
    words = stats.agg(F.sum("ws_words").alias("words"))
    return found.agg(F.count("*").alias("total")).join(words).withColumn("per1000", F.when(F.col("words") > 0, F.floor(F.col("total") / F.col("words") * 100_000 + 0.5) / 100).otherwise(0.0))


def by_rule(found: DataFrame) -> DataFrame:
    """Findings by rule."""
    return found.groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")
