"""Hand-written cases of the detectors, verdicts and extraction."""

import pytest
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.functions.text import java_pattern
from prosemill.operators import analyze, corpus, detect
from prosemill.operators.verdict import Notable, doc_stats, judge
from prosemill.sources.markup import extract_html, extract_markdown, extract_plain, to_source


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_echo_needs_four_shared_words_and_no_gap(spark):
    d = frame(spark, "We saw the old red house. They saw the old red house there.", "We saw the old red house.\n\n\n\n\nThey saw the old red house there.")
    assert [(r.doc_id, r.n) for r in detect.echo(d).collect()] == [(0, 2)]


def test_anaphora_skips_common_openers(spark):
    d = frame(spark, "Ships sail. Ships sink. Ships rust.", "The a. The b. The c.", "Ships sail. Ships sink.")
    assert [(r.doc_id, r.n, r.head) for r in detect.anaphora(d).collect()] == [(0, 3, "ships")]


def test_frame_reads_past_titles(spark):
    s = "Dr. {}, a {} at {} found that it is so."
    text = " ".join(s.format(*x) for x in (("Smith", "reader", "York"), ("Jones", "lecturer", "Bath"), ("Brown", "tutor", "Hull")))
    assert [r.n for r in detect.frames(frame(spark, text)).collect()] == [3]


def test_chain_counts_items_and_trims(spark):
    d = frame(spark, "no dogs, no cats, and no birds here")
    out = d.select(detect.chain(F.col("text"), r"\bno [^,.]+(?:, (?:and )?no [^,.]+)+", r"^no\b").alias("c")).first().c
    assert [(c.n, c.start) for c in out] == [(3, 0)]


def test_question_chain(spark):
    d = frame(spark, "Why? Who? So.", " Why? Then.")
    assert [len(r.q) for r in d.select(detect.question_chain(F.col("text")).alias("q")).collect()] == [1, 0]


def test_rhythm_of_equal_sentences_is_zero_and_of_none_null(spark):
    d = frame(spark, "One two. One two. One two.", "...")
    assert [r.v for r in d.select(detect.rhythm(F.col("text"))[0].alias("v")).collect()] == [0.0, None]


def test_power_and_rate(spark):
    d = frame(spark, "the " * 50 + "word " * 50)
    for rule, want in ((Notable({">": 0}, power=0.5, needs={"words": 0, "sentences": 0}), 5.0), (Notable({">": 0}, power=1.0, needs={"words": 0, "sentences": 0}), 0.5)):
        assert judge(doc_stats(d).withColumn("n", F.lit(50)), F.col("n"), rule).first().value == pytest.approx(want)


def test_bad_rules_are_refused():
    for kw in ({"bounds": {}}, {"bounds": {">": 1}, "per": 1000, "power": 0.5}, {"bounds": {">": 1}, "power": 2}):
        with pytest.raises(ValueError):
            Notable(**kw)


def test_boundaries_are_ascii_and_blanks_wide(spark):
    d = frame(spark, "cafés", "in order", "end\n")
    assert d.where(F.col("text").rlike(java_pattern(r"\bs\b"))).count() == 1
    assert d.where(F.col("text").rlike(java_pattern(r"in\s+order"))).count() == 1
    assert d.where(F.col("text").rlike(java_pattern("end$"))).count() == 0


def test_overlaps_collapse(spark):
    rows = [(1, "a", 1, 0, 10, False), (1, "b", 2, 5, 20, False), (1, "c", 3, 10, 12, False), (1, "d", 4, 0, 0, True)]
    f = spark.createDataFrame(rows, "doc_id long, rule string, rule_ord int, start int, stop int, doc_level boolean")
    assert sorted(r.rule for r in analyze.collapse(f).collect()) == ["a", "c", "d"]


def test_kmeans_separates_two_vocabularies(spark):
    rows = [(i, f"{'x' if i % 2 else 'y'}{j}", 1) for i in range(40) for j in range(6)]
    out = corpus.kmeans(spark.createDataFrame(rows, "doc_id long, word string, tf long"), k=2, iterations=10)
    groups = {(r.doc_id % 2, r.cluster) for r in out.collect()}
    assert len(groups) == 2


def test_kmeans_follows_the_reference_rounds(spark):
    import math
    import random

    rng = random.Random(3)
    bags = {i: {f"w{int(rng.random() ** 2 * 40)}": rng.randint(1, 3) for _ in range(12)} for i in range(60)}
    words, k = sorted({w for b in bags.values() for w in b}), 10

    def centre(members):
        acc = {w: 0.01 + sum(bags[i].get(w, 0) for i in members) for w in words}
        return {w: math.log(x / sum(acc.values())) for w, x in acc.items()}

    seed, start = 12345, [[] for _ in range(k)]
    for i in bags:
        seed = int(float(seed) * 1103515245.0 + 12345.0) % 2**32
        start[int(seed / 2**32 * k)].append(i)
    centres, want = [centre(m or [0]) for m in start], None
    for _ in range(25):
        new = {i: max(range(k), key=lambda c: (round(sum(n * centres[c][w] for w, n in b.items()), 9), -c)) for i, b in bags.items()}  # noqa: B023
        if new == want:
            break
        want = new
        groups = [[i for i in bags if new[i] == c] for c in range(k)]
        centres = [centre(m) if m else centres[c] for c, m in enumerate(groups)]
    rows = [(i, w, n) for i, b in bags.items() for w, n in b.items()]
    assert {r.doc_id: r.cluster for r in corpus.kmeans(spark.createDataFrame(rows, "doc_id long, word string, tf long")).collect()} == want


def test_selector_needs_agreement(spark):
    rows = [(8, 0, 0.9, 0.3, True), (8, 1, 0.1, 0.9, False), (9, 0, 0.9, 0.3, False), (9, 1, 0.2, 0.5, True), (10, 0, 0.5, 0.3, True), (10, 1, 0.4, 0.2, True)]
    f = spark.createDataFrame(rows, "k int, cluster int, stamped double, end_share double, arrived boolean")
    judged = {r.k: (r.signature, r.growth, r.admitted, r.agree) for r in corpus.judge_fits(f).collect()}
    assert judged == {8: (0, 0, 1, True), 9: (0, 1, 1, False), 10: (0, 0, 2, True)}
    assert corpus.choose_fit(f.where("k = 9")).count() == 0
    assert [(r.k, r.cluster) for r in corpus.choose_fit(f).collect()] == [(8, 0)]


def test_html():
    text, runs = extract_html("<p>f<b>o</b>o &amp; bar<!-- x --> baz</p><script>no</script><p>two</p>")
    assert text == "foo & bar baz\ntwo\n"
    assert to_source(runs, text.index("two")) == len("<p>f<b>o</b>o &amp; bar<!-- x --> baz</p><script>no</script><p>")


def test_markdown():
    src = "---\nt: 1\n---\n# Head\nsoft\nwrap *bold* `code` `two words` [link](u) a_b _it_ (`x y`)\n\n```\nno\n```\n- item\n\n| a | b |\n|---|---|\n<!-- prose-ignore-start -->\nnot this\n<!-- prose-ignore-end -->\nend `open\nclose` now\n"
    text, runs = extract_markdown(src)
    assert [" ".join(x.split()) for x in text.split("\n") if x] == ["Head", "soft wrap bold code link a_b it", "item", "a b", "end now"]
    # every copied character is the source's own
    for o, s, n, fixed in runs:
        assert fixed or text[o : o + n].replace(" ", "|") == src[s : s + n].replace(" ", "|")
    assert src[to_source(runs, text.index("link")) :].startswith("link](u)")


def test_plain_wraps_long_lines():
    src = "word " * 1000 + "\n" + "x" * 5000
    text, runs = extract_plain(src)
    assert max(map(len, text.split("\n"))) <= 2000 and text.replace("\n", "") == src.replace("\n", "")
    assert all(fixed or text[o : o + n] == src[s : s + n] for o, s, n, fixed in runs)


def test_a_million_matches_in_one_text(spark):
    """Places come in one pass: a row of a million matches is a matter of seconds, not of its square."""
    d = spark.createDataFrame([("ab, " * 1_000_000,), ("",), (None,), ("a,b" * 33,), (",",)], "text string")
    found = d.select(T.occurrences(F.col("text"), ",").alias("o")).select(F.size("o").alias("n"), F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x["start"]).alias("sum"), F.try_element_at("o", F.lit(-1))["start"].alias("last"))
    n = 1_000_000
    assert sorted(map(tuple, found.where("n is not null").collect())) == sorted([(n, sum(range(2, 4 * n, 4)), 4 * n - 2), (0, 0, None), (33, sum(range(1, 99, 3)), 97), (1, 0, 0)])
    assert found.where("n is null").count() == 1


def test_fold_carries_its_state_over_pieces(spark):
    d = spark.createDataFrame([(list(range(k)),) for k in (0, 1, 31, 32, 33, 1025, 40_000)], "x array<int>")
    step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.when(x % 2 == 0, F.array_append(a["out"], a["at"])).otherwise(a["out"]).alias("out"))
    for r in d.select("x", T.fold(F.col("x"), F.lit(5), "int", step).alias("o")).collect():
        at, want = 5, []
        for x in r.x:
            want += [at] * (x % 2 == 0)
            at += x
        assert r.o == want


def test_many_runs_in_one_text(spark):
    d = spark.createDataFrame([(1, "Cats sleep. Cats eat. Cats run.\n\n\n\n\nDogs bark. " * 3000)], "doc_id long, text string")
    assert detect.anaphora(d).count() == 3000


def test_frames_are_looked_for_where_a_skeleton_repeats(spark):
    """letters and places are found only in texts that hold a skeleton often enough; what is no prose still stands between."""
    one, two, three = "The cat of Ann is in the house by the sea.", "The dog of Bob is in the barn by the mill.", "The hen of Cid is in the shed by the road."
    d = frame(spark, f"{one} {two}", f"{one} {two} {three}", f"{one} {two} x = [y] {{z}}. {three}", f"{one} {two} A gull cries over the wide water. {three}", None, "")
    runs = detect.frames(d)
    assert sorted((r.doc_id, r.start, r.n) for r in runs.collect()) == [(1, 0, 3), (2, 0, 3)]
    assert "array_sort" in runs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.n) for r in detect.frames(d, min_run=2).collect()) == [(0, 2), (1, 3), (2, 3), (3, 2)]
