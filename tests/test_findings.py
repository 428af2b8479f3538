"""Findings assembled by hand-checked cases: anchoring, runs, lineage, measures, vocabularies."""

import json

from pyspark.sql import functions as F

from prosemill.operators import findings, rules
from prosemill.operators.verdict import doc_stats
from prosemill.sources.markup import extracted

FREE = {"words": 0, "sentences": 0, "functionWords": 0}


def made(*rs):
    return rules.resolve([{"name": "t", "rules": [{"severity": "warn"} | r for r in rs]}])


def test_a_document_rule_points_at_its_first_match_or_word(spark):
    rs = made({"id": "few", "match": {"kind": "regex", "pattern": ";"}, "notable": {"<=": 1, "per": 1000, "needs": FREE}}, {"id": "flat", "match": {"kind": "rhythm"}, "notable": {"<": 0.5, "needs": FREE}})
    d = spark.createDataFrame([(1, "  One two; three. Four five six."), (2, "...\nfirst word. Other words."), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.rule): r for r in findings.assemble(d, rs).collect()}
    assert (1, "few") not in got and (got[2, "few"].line, got[2, "few"].col, got[2, "few"].match, got[2, "few"].occurrences) == (2, 1, "first", [])
    assert got[2, "few"].measure == "0 in 4 words, 0 per 1000 <= 1" and got[3, "few"].match == ""
    assert got[1, "flat"].measure.startswith("2 sentences averaging 3 words, variation 0") and got[1, "flat"].rate.kind == "variation"
    block = findings.assemble(d, rs).where("doc_id = 1").select(findings.rate_block(F.col("rate")).alias("b")).first().b
    assert (block.unit, block.bound) == ("sentence-length variation", "< 0.5")


def test_runs_and_chains_are_spans_with_counts(spark):
    rs = made({"id": "echo", "match": {"kind": "echo"}, "notable": {">": 0}}, {"id": "no", "match": {"kind": "chain", "pattern": r"\bno [a-z]+(?:, no [a-z]+)+", "headTest": "^no"}, "notable": {">": 0}})
    d = spark.createDataFrame([(1, "We saw the old red house. They saw the old red house.\nThere are no dogs, no cats.")], "doc_id long, text string")
    got = {r.rule: (r["count"], r.line, r.col, r.match) for r in findings.assemble(d, rs).collect()}
    assert got == {"echo": (2, 1, 1, "We saw the old red house. They saw the old red house."), "no": (2, 2, 11, "no dogs, no cats")}


def test_places_are_those_of_the_source(spark):
    src = "<p>Some <b>bad</b> &amp; w<i>ors</i>e</p>\n<p>A bad end</p>"
    d = extracted(spark.createDataFrame([(1, src, "html"), (2, "# T\n\nso **bad** here", "md"), (3, None, "txt")], "doc_id long, src string, kind string"))
    rs = made({"id": "bad", "match": {"kind": "regex", "pattern": "bad|worse"}, "notable": {">": 0}})
    got = sorted((r.doc_id, r.line, r.col, r.match) for r in findings.assemble(d, rs).collect())
    assert got == [(1, 1, 1 + src.index("bad"), "bad"), (1, 1, 1 + src.index("w<i>"), "worse"), (1, 2, 6, "bad"), (2, 3, 6, "bad")]


def test_overlaps_collapse_and_reports_are_json(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(30)]
    rs = made({"id": "long", "match": {"kind": "regex", "pattern": "aaa bbb"}, "notable": {">": 0}}, {"id": "short", "match": {"kind": "regex", "pattern": "bbb"}, "notable": {">": 0}}, {"id": "list", "match": {"kind": "regex", "pattern": r"\b(?:" + "|".join(words) + r")\b", "distinct": True}, "notable": {">": 0}})
    d = spark.createDataFrame([(1, "aaa bbb ccc bbb waa waa wab"), (2, "nothing")], "doc_id long, text string")
    found = findings.assemble(d, rs).withColumn("file", F.col("doc_id").cast("string"))
    assert sorted((r.rule, r.start) for r in found.collect()) == [("list", 16), ("list", 24), ("long", 0), ("short", 12)]
    stats = doc_stats(d).select(F.col("doc_id").cast("string").alias("file"), "ws_words")
    lines = {r.file: json.loads(r.line) for r in findings.json_report(found, stats, rs).collect()}
    assert [f["rule"] for f in lines["1"]["findings"]] == ["long", "short", "list", "list"] and lines["2"] == {"file": "2", "words": 1, "findings": []}
    assert lines[None]["total"] == 4 and lines[None]["per1000"] == 500.0 and lines[None]["vocabularies"] == {"list": words}
    assert rules.vocabulary_of(rs[0]) is None


def test_places_in_long_texts_with_many_findings(spark):
    """A text of 300,000 characters and 60,000 findings, lines and sentences of any length, against Python."""
    import re
    import random

    rng = random.Random(1)
    parts = [rng.choice(["bad ", "x" * rng.choice([1, 200, 700]) + " ", "ok.", "\n", "é😀 ", "bad!”) ", "…"]) for _ in range(8000)]
    text = "".join(parts) + "bad" + "?" + "”" * 600 + " bad"
    rs = made({"id": "bad", "match": {"kind": "regex", "pattern": "bad"}, "notable": {">": 0}})
    d = spark.createDataFrame([(None, text), (None, "bad"), (3, "bad. " * 50_000), (3, "")], "doc_id long, text string")
    got = findings.assemble(d, rs).select("doc_id", "line", "col", "sentence", "start").collect()
    assert sum(r.doc_id == 3 for r in got) == 50_000
    mine = sorted((r.start, r.line, r.col, r.sentence) for r in got if r.doc_id is None)

    def want(t):
        for m in re.finditer("bad", t):
            a, b = m.span()
            head = re.sub(r"\A\s+", "", t[max(t.rfind(c, 0, a) for c in "\n.!?…") + 1 : a])
            tail = re.match(r"""[^\n.!?…]*(?:[.!?…]["'”’)\]]*)?""", t[b:])[0]
            yield a, t.count("\n", 0, a) + 1, a - t.rfind("\n", 0, a), head + "bad" + tail

    assert mine == sorted([*want(text), *want("bad")])


def test_word_lists_are_looked_up_by_token(spark):
    """Lists of single words count as their pattern does: case, repeats, accents and marks around them included."""
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)] + ["straße"[:4], "x_1"]
    pattern = r"\b(?:" + "|".join(words) + r")\b"
    plain = {"kind": "regex", "pattern": pattern, "flags": "i"}
    rs = made(*({"id": f"{name}{k}", "match": plain | more | ({"pattern": pattern.replace("waa|", "waa|(?:zz)|")} if k else {}), "notable": {">": 0}} for name, more in (("all", {}), ("distinct", {"distinct": True})) for k in (0, 1)))
    assert rules._tokens_suffice(rs[0]) and not rules._tokens_suffice(rs[1])
    texts = ["Waa waa WAB, wab-wac x_1 wax_ éwaa waaé w\u212a", "", "stra stra\u00dfe 'wba' wbb.wbc", "K" * 50, "waa" * 9, "WAA_ _waa 1waa waa1 wa\u0131"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.counts(d, rs).collect():
        assert r.n[0] == r.n[1] and r.n[2] == r.n[3], (texts[r.doc_id], r.n)


def test_ranges_are_claimed_by_priority(spark):
    import random

    from prosemill.operators import analyze

    rng, cases = random.Random(2), []
    for _ in range(60):
        cases.append([(rng.randrange(2), a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(25)))])
    d = spark.createDataFrame(list(enumerate(cases)), "k int, r array<struct<priority: int, start: int, stop: int>>")
    for row in analyze.schedule(d, "r").collect():
        kept = []
        for p, a, b in sorted(cases[row.k], key=lambda r: (r[0], r[1], r[1] - r[2])):
            if not any(a < y and x < b for x, y, _ in kept):
                kept.append((a, b, p))
        assert [tuple(x) for x in row.r] == sorted(kept)


def test_highlights_come_by_line(spark):
    rs = made({"id": "pair", "match": {"kind": "regex", "pattern": r"[a-z]+\.\s+[A-Z][a-z]+"}, "notable": {">": 0}}, {"id": "the", "match": {"kind": "regex", "pattern": "[Tt]he"}, "notable": {">=": 1, "per": 1000, "needs": FREE}})
    d = spark.createDataFrame([(1, "The cat sat.\n \nThe end.  Yes, the"), (2, "x"), (None, "a.\n\nB" + "b" * 300)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.line, r.start, r.stop, r.priority) for r in findings.highlights(d, rs).collect()), key=str)
    assert got == sorted([(1, 1, 0, 3, 1), (1, 1, 8, 12, 0), (1, 3, 15, 18, 0), (1, 3, 19, 28, 0), (1, 3, 30, 33, 1), (None, 1, 0, 2, 0), (None, 3, 4, 305, 0)], key=str)
    blank = [(r.line, r.start, r.stop) for r in findings.highlights(d.where("doc_id = 1"), rs, keep_blank=True).collect()]
    assert (2, 13, 14) in blank


def test_fields_not_asked_for_are_not_made(spark):
    """The planner keeps all fields of a row's findings, so the queries name theirs; a number of occurrences needs no place of each."""
    own = rules.resolve([{"name": "own", "rules": [{"id": "shout", "match": {"kind": "regex", "pattern": "[A-Z]+!!"}, "notable": {">": 0}}, {"id": "commas", "match": {"kind": "regex", "pattern": ","}, "notable": {">=": 1, "per": 1000, "needs": FREE | {"matches": 1}}}]}])
    d = spark.createDataFrame([(1, "One, two, HEY!! three.\nFour, OH!! five. Six."), (2, "None here"), (3, None), (4, "ÄB!! " * 200)], "doc_id long, text string").fillna("")
    whole = findings.assemble(d, own)
    assert whole.columns == ["doc_id", *findings.FIELDS]
    for some in (["line", "col", "rule", "match", "suggest"], ["end_col", "sentence", "match"], ["measure", "n_occurrences"], ["stop", "start"]):
        by = F.size("occurrences").alias("n_occurrences")
        assert sorted(map(str, findings.assemble(d, own, some).collect())) == sorted(map(str, whole.select("*", by).select("doc_id", *some).collect()))
    assert sorted(map(str, findings.rates(d, own).collect())) == sorted(map(str, whole.where("doc_level").select("doc_id", "rule", "rate").collect()))


def test_source_offsets_of_many_runs(spark):
    """Halving finds what a walk through the runs finds, at their edges, between and behind them."""
    runs = [(3 * i + i % 3, 10 * i, 2 + i % 2, i % 5 == 0) for i in range(1, 60)]
    for n in (0, 1, 2, 3, 7, 58, 59):
        some = [(0, 0, 2, False), *runs][:n]
        rows = spark.createDataFrame([(o, some) for o in range(0, 190)], "o int, runs array<struct<o: int, s: int, n: int, fixed: boolean>>")
        got = {r.o: r.at for r in rows.select("o", findings.source_offset(F.col("o"), F.col("runs")).alias("at")).collect()}
        for o, at in got.items():
            before = [r for r in some if r[0] <= o]
            assert at == (before[-1][1] + (0 if before[-1][3] else min(o - before[-1][0], before[-1][2])) if before else 0)


def test_pages_are_taken_apart_in_portions(spark):
    """A worker holds the runs of a megabyte of source at once, not those of a whole batch."""
    import pyarrow as pa

    from prosemill.sources.markup import portions

    texts = ["x" * 400, None, "é" * 300, "", "y" * 5000, "z"] * 3
    batch = pa.RecordBatch.from_pydict({"k": list(range(18)), "src": texts})
    made = list(portions(batch, 1, 1000))
    assert sum((p.column(0).to_pylist() for p in made), []) == list(range(18))
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 1000 for p in made) and len(made) > 6
    assert [p.num_rows for p in portions(batch.slice(0, 0), 1)] == [0]
    got = extracted(spark.createDataFrame([(1, "<p>a <b>b</b></p>", "html"), (2, None, "html"), (3, "c", "txt")], "doc_id long, src string, kind string")).orderBy("doc_id").collect()
    assert [r.text for r in got][1:] == ["", "c"] and got[0].runs and "a b" in got[0].text
