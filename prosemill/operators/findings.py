"""Assembled findings: anchoring A2, assembly A4, navigation A8, rate presentation A10, and the JSON report K2.

Findings are matched, judged, collapsed and finished in one projection over one scan. Texts may come from markup: with
the columns src and runs (sources.markup.extracted), places are those of the source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import RATE_WORD, let
from . import analyze, rules, spans
from .spans import SPAN, SPAN_PLACE
from .verdict import shown

GLYPH = {">=": "≥", "<=": "≤", ">": ">", "<": "<"}


def _number(x: Column) -> Column:
    """A number as it is read: whole ones without a point."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def _meta(rule_list: list[dict]) -> Column:
    """The rules' words about themselves, as one constant array."""

    def one(r: dict) -> Column:
        n = rules.notable_of(r)
        texts = {"rule": r["id"], "set": r.get("set"), "severity": r.get("severity", "warn"), "name": r.get("name", r["id"]), "why": r.get("description"), "suggest": r.get("suggest"), "unit": r["notable"].get("unit", "words")}
        numbers = {"per": n.per, "power": n.power}
        return F.struct(*(F.lit(v).cast("string").alias(k) for k, v in texts.items()), *(F.lit(v).cast("double").alias(k) for k, v in numbers.items()), F.lit(n.metric).alias("metric"))

    return F.array(*map(one, rule_list))


def source_offset(offset: Column, runs: Column) -> Column:
    """The source offset of a text offset; past the end, the end of the last run."""


    def halved(a: Column, _) -> Column:
        # the run lies in [lo, hi); runs are in order, so a page of many runs and findings costs their logarithm
        return let(F.floor((a["lo"] + a["hi"]) / 2).cast("int"), lambda m: F.when(F.get(runs, m)["o"] <= offset, F.struct(m.alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), m.alias("hi"))))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(runs).cast("double"))).cast("int"))
    last = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(runs).alias("hi")), halved, lambda a: a["lo"])
    inside = let(F.get(runs, last), lambda at: at["s"] + F.when(at["fixed"], 0).otherwise(F.least(offset - at["o"], at["n"])))
    return F.when(F.size(runs) == 0, 0).otherwise(inside).cast("int")


def placed(docs: DataFrame, rule_list: list[dict], with_spans: bool = True, with_places: bool = False) -> DataFrame:
    """docs with verdicts, kept and, if wanted, spans (array<array>, by rule): A1-A3 inside each row.

    kept: array<struct<start, neg, rule_ord, doc_level, n>> in order, neg being minus the end. Every rule's matches are
    made once; its count is their number. with_places: kept and spans tell their places in the text as well. Their lengths and gaps go to spans.found(), which makes places of them and
    collapses overlaps for a batch of rows at once. Nothing is shuffled, so texts stay where they were read.
    """
    text, kinds = F.col("text"), [r["match"]["kind"] for r in rule_list]
    metrics = F.array(*(rules.detect.rhythm(text, r["match"].get("minSentenceWords", 1), r["match"].get("maxSentenceWords", 200))[0] if k == "rhythm" else F.lit(None).cast("double") for r, k in zip(rule_list, kinds, strict=True)))
    plain = list(map(rules.in_numbers, rule_list))
    no_numbers, no_spans = F.lit(None).cast("array<int>"), F.lit(None).cast(f"array<{SPAN}>")
    rows = rules.with_stats(docs, rule_list).withColumns(
        {
            "lengths_": F.array(*(rules.lengths_of(r) if p else no_numbers for r, p in zip(rule_list, plain, strict=True))),
            "others_": F.array(*(no_spans if p else rules.spans_of(r) for r, p in zip(rule_list, plain, strict=True))),
            "metrics_": metrics if "rhythm" in kinds else F.lit(None).cast("array<double>"),
        }
    )
    size = lambda k: F.greatest(F.size(F.get("lengths_", k)), F.lit(0)) + F.greatest(F.size(F.get("others_", k)), F.lit(0))
    rows = rows.withColumns(
        {
            "gaps_": F.array(*(rules.gaps_of(r, F.get("lengths_", F.lit(k))) if p else no_numbers for k, (r, p) in enumerate(zip(rule_list, plain, strict=True)))),
            "sizes_": F.array(*(size(F.lit(k)) for k in range(len(rule_list)))),
        }
    )

    def judged(made: Column) -> Column:
        n = lambda t, k: F.when(t["metric"], F.get(made["m"], k)).otherwise(F.get(made["s"], k).cast("double"))
        return F.transform(rules.terms(rule_list), lambda t, k: let(n(t, k), lambda x: rules.verdict(t, x)))

    # bound outside: put into the lambda by the planner, all sizes would be made again for each rule
    rows = rows.withColumn("verdicts", let(F.struct(F.col("sizes_").alias("s"), F.col("metrics_").alias("m")), judged))
    # what lies before the first word is measured in code points, as everywhere; the engine's own place counts surrogates twice
    before, first = F.length(F.regexp_extract(text, "^[^A-Za-z0-9]*+", 0)), F.regexp_extract(text, RATE_WORD, 0)
    word = F.struct(F.when(first == "", -1).otherwise(before).alias("start"), (before + F.length(first)).alias("stop"))
    # read twice, the verdicts stay a column of their own; the planner does not find a function of Python around their expression
    fires, counts = F.transform("verdicts", lambda v: v["bound"].isNotNull()), F.transform("verdicts", lambda v: v["n"].cast("int"))
    pieces = lambda mark: F.transform(F.split(text, mark, -1), F.length)
    breaks = F.struct(pieces("\n").alias("lines"), pieces("[\n.!?…]").alias("terms")) if with_places else None
    made = spans.found(F.col("lengths_"), F.col("gaps_"), F.col("others_"), fires, counts, word, _doc_level(rule_list), with_spans, breaks)
    rows = rows.withColumn("made_", made).withColumn("kept", F.col("made_.kept"))
    return (rows.withColumn("spans", F.col("made_.spans")) if with_spans else rows).drop("lengths_", "others_", "metrics_", "gaps_", "sizes_", "made_")


def kept_spans(docs: DataFrame, rule_list: list[dict]) -> DataFrame:
    """A2 A3: (doc_id, rule, rule_ord, start, stop, doc_level) of every finding, for what needs no texts."""
    names = F.array(*(F.lit(r["id"]) for r in rule_list))
    one = lambda f: F.struct(F.get(names, f["rule_ord"]).alias("rule"), f["rule_ord"].alias("rule_ord"), f["start"].alias("start"), (-f["neg"]).alias("stop"), f["doc_level"].alias("doc_level"))
    return placed(docs.select("doc_id", "text"), rule_list, False).select("doc_id", F.inline(F.transform("kept", one)))


def rates(docs: DataFrame, rule_list: list[dict]) -> DataFrame:
    """A4 A10: (doc_id, rule, rate) of the document-level findings, for what needs no places."""
    meta = _meta(rule_list)
    one = lambda f: F.struct(F.get(meta, f["rule_ord"])["rule"].alias("rule"), _told(F.get(meta, f["rule_ord"]), F.get("verdicts", f["rule_ord"]))[1].alias("rate"))
    return placed(docs.select("doc_id", "text"), rule_list, False).select("doc_id", F.inline(F.transform(F.filter("kept", lambda f: f["doc_level"]), one)))


#: The fields of a finding, in their order; n_occurrences is the number of occurrences, for what does not show them.
FIELDS = "line col end_line end_col rule set severity name why suggest count match sentence doc_level measure rate occurrences rule_ord start stop".split()


def assemble(docs: DataFrame, rule_list: list[dict], fields: list[str] = FIELDS) -> DataFrame:
    """A1-A4: one row a finding: doc_id, line, col, end_line, end_col, the rule's words, count, match, sentence, doc_level, measure, rate, occurrences, start, stop.

    fields: those that are wanted. The planner cannot leave out fields of a row's findings, so what is not asked for
    here is made all the same: the places of each occurrence above all.

    docs: doc_id (of any kind, nulls and repeats included) and text; src and runs if text was taken out of markup.
    Findings are finished inside their row, by a table of the text's places (analyze.place_table), and only then come
    apart: no text is shuffled or copied.
    """
    lineage = "runs" in docs.columns
    wants = set(fields)
    with_places = not lineage and bool(wants & {"line", "col", "end_line", "end_col", "sentence", "occurrences"})
    rows = placed(docs.select("doc_id", "text", *(["src", "runs"] if lineage else [])), rule_list, with_places=with_places)
    text, meta = F.col("text"), _meta(rule_list)

    def finished(table: Column, sources: Column, length: Column) -> Column:
        def placed_at(off: Column, use, *more: str) -> Column:
            """use(place in the text with the fields named, line and column in the source), where texts come from markup."""
            return let(F.struct(analyze.place(table, off, *more).alias("t"), analyze.place(sources, source_offset(off, F.col("runs")), "line", "col").alias("s")), lambda x: use(x["t"], x["s"]))

        def occurrence(o: Column) -> Column:
            around = [analyze.cut(table, o["start"], o["stop"]).alias("match"), analyze.window_around(table, length, o["start"], o["stop"]).alias("context")]
            told = lambda _, p: F.struct(p["line"].alias("line"), p["col"].alias("col"), *around)
            return placed_at(o["start"], told) if lineage else told(o, o)

        def ends(f: Column) -> Column:
            """A finding with the places of its ends, as far as they are wanted."""
            if not lineage and not with_places:
                return F.struct(f.alias("f"))
            if not lineage:
                a, b = (F.struct(*(f[x].alias(y) for x, y in names.items())) for names in ({"sentence": "sentence", "line": "line", "col": "col"}, {"ends": "ends", "end_line": "line", "end_col": "col"}))
                return F.struct(f.alias("f"), a.alias("a"), b.alias("b"))
            spots = {"a": (f["start"], "sentence", {"line", "col", "sentence"}), "b": (-f["neg"], "ends", {"end_line", "end_col", "sentence"})}
            return F.struct(f.alias("f"), *(placed_at(off, lambda t, s: F.struct(t[more].alias(more), s["line"].alias("line"), s["col"].alias("col")), more).alias(c) for c, (off, more, names) in spots.items() if wants & names))

        def around(x: Column) -> Column:
            return F.struct(*(x[c].alias(c) for c in "fab"), analyze.sentence_around(table, length, x["f"]["start"], x["a"]["sentence"], x["b"]["ends"]).alias("x"))

        def made(z: Column) -> Column:
            f = z["f"]
            start, stop = f["start"], -f["neg"]
            measure, rate = _told(F.get(meta, f["rule_ord"]), F.get("verdicts", f["rule_ord"]))
            only = lambda x: F.when(f["doc_level"], x)
            listed = F.when(f["doc_level"], F.get("spans", f["rule_ord"])).otherwise(F.expr(f"cast(array() as array<{SPAN[:-1] + SPAN_PLACE if with_places else SPAN}>)"))
            told = {
                "line": lambda: z["a"]["line"], "col": lambda: z["a"]["col"], "end_line": lambda: z["b"]["line"], "end_col": lambda: z["b"]["col"],
                "match": lambda: F.substring(z["x"]["body"], start - z["a"]["sentence"] + 1, stop - start) if "sentence" in wants else analyze.cut(table, start, stop),
                "sentence": lambda: z["x"]["text"], "count": lambda: f["n"], "doc_level": lambda: f["doc_level"], "measure": lambda: only(measure), "rate": lambda: only(rate),
                "occurrences": lambda: F.transform(listed, occurrence), "n_occurrences": lambda: F.size(listed), "start": lambda: start, "stop": lambda: stop,
            }
            return F.struct(f["rule_ord"].alias("rule_ord"), *(told[c]().alias(c) for c in fields if c in told))

        # one step after another, not one inside the other: each would copy what is made in it
        placed_ = F.transform("kept", ends)
        return F.transform(F.transform(placed_, around) if "sentence" in wants else placed_, made)

    tables = F.struct((analyze.place_table(text) if lineage else analyze.pieces_of(text)).alias("text"), F.length(text).alias("n"), *([analyze.place_table(F.col("src")).alias("src")] if lineage else []))
    found = F.when(F.size("kept") > 0, let(tables, lambda t: finished(t["text"], t["src"] if lineage else t["text"], t["n"])))
    words = {c: F.get(meta, F.col("rule_ord"))[c].alias(c) for c in ("rule", "set", "severity", "name", "why", "suggest")}
    return rows.select("doc_id", F.inline(found)).select("doc_id", *(words.get(c, c) for c in fields))


def highlights(docs: DataFrame, rule_list: list[dict], keep_blank: bool = False) -> DataFrame:
    """(doc_id, line, start, stop, priority): what is marked in each line of a text.

    Spans of findings have priority 0, the occurrences behind a document-level finding 1: a flagged phrase is never
    hidden by the evidence of a measurement.
    """

    def ranges(f: Column) -> Column:
        one = lambda o, p: F.struct(F.lit(p).alias("priority"), o["start"].alias("start"), o["stop"].alias("stop"))
        evidence = F.transform(F.get("spans", f["rule_ord"]), lambda o: one(o, 1))
        return F.when(f["doc_level"], evidence).otherwise(F.array(F.struct(F.lit(0).alias("priority"), f["start"].alias("start"), (-f["neg"]).alias("stop"))))

    rows = placed(docs.select("doc_id", "text"), rule_list).select("doc_id", "text", F.flatten(F.transform("kept", ranges)).alias("ranges"))
    rows = analyze.schedule(rows, "ranges").withColumn("table", F.when(F.size("ranges") > 0, analyze.place_table(F.col("text"))))
    return rows.select("doc_id", F.inline(analyze.split_by_line(F.col("table"), F.col("text"), F.col("ranges"), keep_blank)))


def _doc_level(rule_list: list[dict]) -> list[bool]:
    return [n.metric or n.per is not None or n.power is not None for n in map(rules.notable_of, rule_list)]


def _told(r: Column, v: Column) -> tuple[Column, Column]:
    """A4: (measure, rate) of a document-level verdict v of the rule r, in the statistics of its row."""
    value, count, words, sentences = shown(v["value"]), v["n"].cast("long"), F.col("rate_words"), F.col("rhythm_sentences")
    where = F.concat_ws(" ", v["bound"], _number(v["limit"]))
    detail = F.when(r["metric"], F.concat(sentences.cast("string"), F.lit(" sentences averaging "), F.floor(words / sentences + 0.5).cast("string"), F.lit(" words")))
    measure = (
        F.when(r["metric"], F.concat(detail, F.lit(", variation "), _number(value), F.lit(" "), where))
        .when(r["power"].isNotNull(), F.concat_ws(" ", count.cast("string"), F.lit("different"), r["unit"], F.lit("in"), F.concat(words.cast("string"), F.lit(",")), _number(value), F.lit("length-adjusted"), where))
        .otherwise(F.concat_ws(" ", count.cast("string"), F.lit("in"), words.cast("string"), F.concat(r["unit"], F.lit(",")), _number(value), F.lit("per"), _number(r["per"]), where))
    )
    fields = {"value": value, "per": r["per"], "power": r["power"], "unit": r["unit"], "op": v["bound"], "threshold": v["limit"], "count": count, "words": words, "detail": detail, "kind": F.when(r["metric"], "variation").otherwise("rate")}
    return measure, F.named_struct(*(x for k, y in fields.items() for x in (F.lit(k), y)))


def navigation(found: DataFrame, save) -> DataFrame:
    """doc_id, start, rule_ord of each finding with those of the ones before and after it, across documents.

    Rows are dealt by ranges of the order, so neighbours meet in their range; what crosses ranges is one row a range.
    save() writes a table and reads it back: the findings, so that they are made once, and their ranges, which stay as they are.
    """
    key = ["doc_id", "start", "rule_ord"]
    # written first: the bounds of the ranges are sampled, for which the findings would be made a second time
    rows = save(found.select(*key)).repartitionByRange(*key).withColumn("part", F.spark_partition_id())
    rows = save(rows)
    one = F.struct(*key)
    w = Window.partitionBy("part").orderBy(*key)
    inside = rows.select(*key, "part", F.lag(one).over(w).alias("before"), F.lead(one).over(w).alias("after"))
    edges = rows.groupBy("part").agg(F.min(one).alias("lo"), F.max(one).alias("hi"))  # one row a range
    e = Window.orderBy("part")
    edges = F.broadcast(edges.select("part", F.lag("hi").over(e).alias("earlier"), F.lead("lo").over(e).alias("later")))
    return inside.join(edges, "part").select(*key, F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after"))


def rate_block(rate: Column) -> Column:
    """A10: struct<value, unit, bound, sub>: a rate in the parts in which it is shown."""
    unit = F.when(rate["kind"] == "variation", "sentence-length variation").when(rate["power"].isNotNull(), "length-adjusted").otherwise(F.concat_ws(" ", F.lit("per"), _number(rate["per"]), rate["unit"]))
    glyph = reduce(lambda a, op: F.when(rate["op"] == op, GLYPH[op]).otherwise(a), GLYPH, rate["op"])
    count, words = rate["count"].cast("string"), rate["words"].cast("string")
    sub = (
        F.when(rate["kind"] == "variation", rate["detail"])
        .when(rate["power"].isNotNull(), F.concat_ws(" ", count, F.lit("different"), rate["unit"], F.lit("matched, in"), words, rate["unit"]))
        .otherwise(F.concat_ws(" ", count, F.when(rate["count"] == 1, "occurrence").otherwise("occurrences"), F.lit("in"), words, F.lit("words")))
    )
    return F.struct(_number(rate["value"]).alias("value"), unit.alias("unit"), F.concat_ws(" ", glyph, _number(rate["threshold"])).alias("bound"), sub.alias("sub"))


def json_report(found: DataFrame, stats: DataFrame, rule_list: list[dict], config: str | None = None) -> DataFrame:
    """K2: the report as JSON lines: one for each file with its words and findings, and one for the run.

    found: file and the columns of assemble(); stats: file, ws_words. A file's findings are one line, as a file's are
    one text; the run's line has totals, rules and the vocabularies of word-list rules that fired.
    """
    own = [c for c in found.columns if c not in ("doc_id", "rule_ord", "start", "stop")]
    by = found.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "rule_ord", F.struct(*own).alias("f")))).alias("list"))
    files = stats.select("file", F.col("ws_words").alias("words")).join(by, "file", "left")
    listed = F.transform(F.coalesce("list", F.array().cast(by.schema["list"].dataType)), lambda x: x["f"])
    lines = files.select("file", F.to_json(F.struct("file", "words", listed.alias("findings"))).alias("line"))
    total = stats.agg(F.sum("ws_words").alias("words")).join(found.agg(F.count("*").alias("total"), F.collect_set("rule").alias("fired")))
    per = F.when(F.col("words") > 0, F.floor(F.col("total") / F.col("words") * 100_000 + 0.5) / 100).otherwise(0.0)
    lists = {r["id"]: w for r in rule_list if (w := rules.vocabulary_of(r))}
    words_ = F.create_map(*(x for k, w in lists.items() for x in (F.lit(k), F.array(*map(F.lit, w))))) if lists else F.expr("cast(map() as map<string, array<string>>)")
    fired = F.map_filter(words_, lambda k, _: F.array_contains("fired", k))
    run = total.select(F.lit(None).cast("string").alias("file"), F.to_json(F.struct("total", "words", per.alias("per1000"), F.array(*(F.lit(r["id"]) for r in rule_list)).alias("rules"), F.lit(config).cast("string").alias("config"), F.when(F.size(fired) > 0, fired).alias("vocabularies"))).alias("line"))
    return lines.unionByName(run)
