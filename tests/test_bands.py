"""Bands by sketches against exact percentiles; sets made of them; claims read out of texts."""

import random

from prosemill.operators import bands, evaluate, rules


def values(spark):
    rng = random.Random(3)
    rows = [(k % 7, "essay" if k % 3 else "mail", "comma", None if k % 50 == 0 else round(rng.expovariate(0.02), 1)) for k in range(40_000)]
    return spark.createDataFrame(rows, "source int, register string, metric string, value double").repartition(6), rows


def test_bands_lie_within_the_bound_of_exact_percentiles(spark):
    rates, rows = values(spark)
    whole = bands.sketches(rates, "register")
    parts = bands.merged(bands.sketches(rates, "source", "register"), "register")
    for held in (whole, parts):
        for r in bands.bands(held, 0.1, 0.9).collect():
            mine = sorted(v for _, g, _, v in rows if g == r.register and v is not None)
            assert r.n == len(mine)
            for p, x in ((0.1, r.lo), (0.9, r.hi)):
                below, upto = sum(v < x for v in mine) / len(mine), sum(v <= x for v in mine) / len(mine)
                assert below - bands.OFF <= p <= upto + bands.OFF
    crossed = bands.outside(rates, bands.bands(whole), "register").groupBy("bound").count().collect()
    shares = {r.bound: r["count"] / 40_000 for r in crossed}
    assert 0.09 < shares["<="] < 0.12 and 0.09 < shares[">="] < 0.12


def test_style_rates_and_a_set_of_bands(spark):
    texts = ["You said it. Your turn, then. We left, and it was closed.", "", "One. Two three four five six seven eight.", None]
    d = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.metric): r.value for r in bands.style_rates(d.na.fill({"text": ""}), "lang").collect()}
    n = 12
    assert got[0, "comma"] == 2 / n * 1000 and got[0, "second-person"] == 2 / n * 1000 and got[0, "passive"] == 1 / n * 1000 and got[0, "sentence-length"] == 3 / n * 1000
    assert got[1, "comma"] is None and got[1, "rhythm"] is None and got[2, "rhythm"] > 0.5
    s = bands.style_set("plain", [{"metric": "comma", "lo": 30.0, "hi": 85.0}, {"metric": "rhythm", "lo": 0.2, "hi": 0.7}], bands.FREE)
    fired = {(r.doc_id, r.rule, r.bound) for r in rules.evaluate(d.na.fill({"text": ""}), rules.resolve([s], select=["plain"])).where("fires").collect()}
    assert (0, "comma", ">=") in fired and (2, "comma", "<=") in fired and (2, "rhythm", ">=") in fired


def test_claims_are_read_and_held_against_values(spark):
    texts = [
        ("a.md", "We keep **over 1,200 documents** here,\nand about **40% signed pages**. Exactly 7 sides exist."),
        ("b.md", "There are over 2,000 documents. Around 90% signed pages, 8 sides, 3 unknown things and 12 monkeys."),
        ("c.md", "Over 100 documents; no figure for sides."),
    ]
    d = spark.createDataFrame(texts, "file string, text string")
    values_ = spark.createDataFrame([("documents", 1250.0), ("% signed pages", 41.5), ("sides", 7.0), ("lines", 1.0)], "subject string, value double")
    got = {(r.file, r.subject): (r.kind, r.stated, r.ok) for r in evaluate.checked_claims(d, values_).collect()}
    assert got == {
        ("a.md", "documents"): ("floor", 1200.0, True), ("a.md", "% signed pages"): ("about", 40.0, True), ("a.md", "sides"): ("exact", 7.0, True),
        ("b.md", "documents"): ("floor", 2000.0, False), ("b.md", "% signed pages"): ("about", 90.0, False), ("b.md", "sides"): ("exact", 8.0, False),
        ("c.md", "documents"): ("floor", 100.0, False),
    }
    assert [r.subject for r in evaluate.unstated(d, values_).collect()] == ["lines"]


def test_list_words_of_documents_and_their_beginnings(spark):
    d = spark.createDataFrame([(1, "human", "aa bb cc aa dd"), (2, "ai", "dd")], "doc_id long, side string, text string")
    listed = spark.createDataFrame([("aa", 1), ("dd", 2)], "word string, rank int")
    for most in (10, 0):  # broadcast or not
        rows, hits = evaluate.list_hits(d, listed, [0, 2], max_broadcast=most)
        assert sorted((r.doc_id, r.length, r.words) for r in rows.collect()) == [(1, 0, 5), (1, 2, 2), (2, 0, 1), (2, 2, 1)]
        assert sorted((r.doc_id, r.length, r["rank"]) for r in hits.collect()) == [(1, 0, 1), (1, 0, 2), (1, 2, 1), (2, 0, 2), (2, 2, 2)]


def test_only_wanted_metrics_are_counted(spark):
    """the patterns of metrics that nobody asked for are not in the plan, and the rates of the others stay."""
    d = spark.createDataFrame([(k, t, "en") for k, t in enumerate(["You said it, once. Your turn, then.", "One two."])], "doc_id long, text string, lang string")
    some = bands.style_rates(d, "lang", metrics=("comma", "sentence-length"))
    every = bands.style_rates(d, "lang").where("metric in ('comma', 'sentence-length')")
    assert sorted(some.collect()) == sorted(every.collect()) and some.count() == 4
    assert "tion|ment" in every._jdf.queryExecution().optimizedPlan().toString() and "tion|ment" not in some._jdf.queryExecution().optimizedPlan().toString()


def test_cut_lists_are_made_once(spark, tmp_path):
    """both parts of list_hits are read from one table, which holds listed words alone."""
    d = spark.createDataFrame([(1, "ai", "one two two three zebra"), (2, "human", "")], "doc_id long, side string, text string")
    listed = spark.createDataFrame([("two", 1), ("zebra", 2)], "word string, rank int")
    written = []

    def save(df):
        written.append(f"{tmp_path}/{len(written)}")
        df.write.parquet(written[-1])
        return spark.read.parquet(written[-1])

    rows, hits = evaluate.list_hits(d, listed, [0, 2], save=save)
    assert len(written) == 1 and sorted(r.list for r in spark.read.parquet(written[0]).where("doc_id = 1").collect()) == [["two"], ["two", "zebra"]]
    assert sorted(map(tuple, rows.select("doc_id", "length", "words").collect())) == [(1, 0, 5), (1, 2, 2), (2, 0, 0), (2, 2, 0)]
    assert sorted(map(tuple, hits.collect())) == [(1, 0, 1), (1, 0, 2), (1, 2, 1)]
