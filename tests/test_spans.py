"""Spans by their numbers, against plain walks over each text; findings and highlights are made once, inside the row."""

import random
import re

from pyspark.sql import functions as F

from prosemill.operators import analyze, findings, rules

FREE = {"words": 0, "sentences": 0, "functionWords": 0}


def made(*rs):
    return rules.resolve([{"name": "t", "rules": [{"severity": "warn"} | r for r in rs]}])


def own(*more):
    kinds = [("ab", "a+b?", {">": 0}), ("bc", "b c|bb", {">": 1}), ("few", ";", {"<=": 900, "per": 1000, "needs": FREE}), ("dots", "[.]", {">=": 1, "per": 1000, "needs": FREE})]
    return made(*({"id": k, "match": {"kind": "regex", "pattern": p}, "notable": n} for k, p, n in kinds), *more)


def plain(text):
    """(start, stop, rule) of the rules above: matches by pattern, overlaps collapsed, a rule of the document at its first match or word."""
    found = {k: [m.span() for m in re.finditer(p, text)] for k, p in enumerate(("a+b?", "b c|bb", ";", "[.]"))}
    words = len(re.findall("[A-Za-z0-9][A-Za-z0-9'’-]*", text))
    first = re.search("[A-Za-z0-9][A-Za-z0-9'’-]*", text)
    rate = [1000 * len(found[k]) / words if words else 0 for k in range(4)]
    spans = [(a, -b, k) for k in (0, 1) if len(found[k]) > k for a, b in found[k]]
    anchor = lambda k: found[k][0] if found[k] else first.span() if first else (0, 0)
    docs = [(anchor(k)[0], -anchor(k)[1], k) for k, fires in ((2, rate[2] <= 900), (3, rate[3] >= 1)) if fires]
    out, at = [], -1
    for a, neg, k in sorted(spans + docs):
        if k > 1 or a >= at:
            out.append((a, -neg, k))
            at = at if k > 1 else -neg
    return out


def test_places_and_overlaps_of_a_batch_of_texts(spark):
    """Texts with and without matches, empty and null ones among them, beyond the Basic Plane as well."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("aabbc .;\n😀") for _ in range(rng.choice([0, 1, 5, 60, 400]))) for _ in range(300)]
    d = spark.createDataFrame([*enumerate(texts), (300, None)], "doc_id long, text string").repartition(3)
    got = {}
    for r in findings.kept_spans(d, own()).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.stop, r.rule_ord))
    assert got == {i: x for i, t in enumerate(texts) if (x := plain(t))}


def test_places_of_matches_go_beside_those_of_other_kinds(spark):
    echo = {"id": "echo", "match": {"kind": "echo"}, "notable": {">": 0}}
    d = spark.createDataFrame([(1, "ab. We saw the old red house. They saw the old red house. ab"), (2, "no")], "doc_id long, text string")
    rows = {r.doc_id: r for r in findings.placed(d, own(echo)).collect()}
    assert [(s.start, s.stop, s.n) for s in rows[1].spans[3]] == [(2, 3, None), (28, 29, None), (56, 57, None)]
    assert [(s.start, s.stop, s.n) for s in rows[1].spans[4]] == [(3, 57, 2)] and not rows[1].spans[1]
    assert [(k.start, -k.neg, k.n) for k in rows[1].kept if k.rule_ord == 4] == [(3, 57, 2)] and [len(s) for s in rows[2].spans] == [0] * 5


def test_territory_is_claimed_as_by_a_walk(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        ranges = [(rng.randrange(2), a, a + rng.choice([0, 1, 2, 7])) for a in (rng.randrange(60) for _ in range(rng.randrange(12)))]
        rows.append((i, ranges))
    d = spark.createDataFrame(rows, "doc_id long, r array<struct<priority: int, start: int, stop: int>>")
    for row in analyze.schedule(d, "r").collect():
        kept = []
        for p in (0, 1):
            at, before = -1, list(kept)
            for a, b in sorted(((a, b) for q, a, b in rows[row.doc_id][1] if q == p), key=lambda x: (x[0], -x[1])):
                if all(d <= a if c <= a else b <= c for c, d, _ in before) and a >= at:
                    kept.append((a, b, p))
                    at = b
        assert [(x.start, x.stop, x.priority) for x in row.r] == sorted(kept, key=lambda x: (x[0], -x[1], x[2]))


def test_findings_are_made_once_for_navigation(spark):
    """The ranges are sampled from a written table: no rule is matched for the bounds and again for the rows."""
    from prosemill.sources.files import saved

    tables = []
    save = lambda df: tables.append(df) or saved(df, "navigation")
    d = spark.createDataFrame([(i, "a ab b") for i in range(50)], "doc_id long, text string")
    got = findings.navigation(findings.kept_spans(d, own()), save)
    plans = [t._jdf.queryExecution().optimizedPlan().toString() for t in tables]
    assert [("made(" in p, "RepartitionByExpression" in p) for p in plans] == [(True, False), (False, True)]
    assert got.count() == sum(len(plain("a ab b")) for _ in range(50)) and got.where(F.col("before").isNull()).count() == 1

def test_places_are_told_beside_the_spans(spark):
    """Lines, columns and the bounds of sentences of findings and occurrences, without a table of the text's places."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("aab .;\n!😀") for _ in range(rng.choice([0, 1, 5, 60, 700]))) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for row in findings.placed(d, own(), with_places=True).collect():
        text = texts[row.doc_id]
        place = lambda off: (text[:off].count("\n") + 1, off - text[:off].rfind("\n"))  # noqa: E731, B023
        for k in row.kept:
            begins = max(text[: k.start].rfind(c) for c in "\n.!?…") + 1
            ends = min((i for c in "\n.!?…" if (i := text.find(c, -k.neg)) >= 0), default=len(text))
            assert (k.line, k.col, k.end_line, k.end_col, k.sentence, k.ends) == (*place(k.start), *place(-k.neg), begins, ends)
        assert all((s.line, s.col) == place(s.start) for one in row.spans for s in one)
