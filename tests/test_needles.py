import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prosemill.functions.needles import begins_of, may_match, needles_of, whole_words_of
from prosemill.functions.text import java_pattern
from prosemill.operators import rules as R
from prosemill.plans import catalog, rulebook


def test_needles_of_patterns():
    assert needles_of(r"\bnot\s+only\b") == ["only"]
    assert needles_of(r"(?:delv(?:e|ing)|vibrant)") == ["delve", "delving", "vibrant"]
    assert needles_of(r"\w+ing\b|x") is None and needles_of(r"[ab]+") is None and needles_of(r"(?:abc)?") is None
    assert needles_of(r"(?<!un)lock(?!s)") == ["lock"]
    assert needles_of(r"(") is None


WORDS = sorted({w for r in catalog.RULES for w in re.findall(r"[A-Za-z]{2,}", r["match"].get("pattern", ""))})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*WORDS, ", ", ". ", "? ", "'s ", "-", "\n"]), max_size=14))
def test_a_match_holds_a_needle(parts):
    text = " ".join(parts)
    for r in catalog.RULES:
        pattern = r["match"].get("pattern")
        if pattern is None or re.search(r"\(\?<[!=]", pattern):
            continue
        found = needles_of(pattern)
        if found and re.search(pattern, text, re.I):
            assert any(n in text.lower() for n in found), (r["id"], text)


def test_may_match(spark):
    d = spark.createDataFrame([("a DELVE b",), ("none",), ("",), (None,)], "text string")
    got = d.select(may_match(F.lower("text"), r"\b(?:delve|bolster|vibrant)\b").alias("x")).collect()
    assert [r.x for r in got] == [True, False, False, None]


def test_advisory_rules(spark):
    rule = R.prepared({"rules": [{"id": "x", "match": {"kind": "regex", "pattern": r"a b[ -]c\ d"}, "notable": {">=": 1, "per": 1000}}]})["rules"][0]
    assert rule["match"]["pattern"] == r"a\s+b[ -]c\ d" and rule["notable"]["needs"] == {"words": 80, "sentences": 3, "matches": 2}
    active = R.resolve(rulebook.SETS, select=["consultant"])
    assert len(active) == 24 and not any(r["notable"].get("needs", {}).get("words") == 80 for r in active if "<=" in r["notable"])
    texts = {
        "consultant-key": ("The key drivers of growth.", "The API key pair is old."),
        "consultant-drive": ("We drive significant growth.", "The hard drive value is 3."),
        "machine-phrases": ("It will pave\nthe way for it.", "They paved a road."),
        "tight-exclamation": ("Do it now!", "if a != b"),
        "tight-hedge-stack": ("It may possibly work.", "It may work."),
        "housestyle-em-dash": ("One — two.", "One-two."),
        "tight-empty-modifier": ("A strategic approach.", "A strategic deal value."),
        "consultant-jargon": ("A holistic, best-in-class, end to end plan.", "Holistic holistic holistic net leverage ratio."),
    }
    d = spark.createDataFrame([(2 * k + j, t) for k, pair in enumerate(texts.values()) for j, t in enumerate(pair)], "doc_id long, text string")
    fired = {(r.doc_id, r.rule) for r in R.evaluate(d, active).where("fires").collect()}
    for k, name in enumerate(texts):
        assert (2 * k, name) in fired and (2 * k + 1, name) not in fired, name


def test_explicit_gates_hold_for_bare_counts(spark):
    rule = {"id": "g", "match": {"kind": "regex", "pattern": "zz"}, "notable": {">": 0, "needs": {"words": 3}}}
    d = spark.createDataFrame([(1, "zz a"), (2, "zz a b"), (3, "")], "doc_id long, text string")
    assert [r.doc_id for r in R.evaluate(d, [rule]).where("fires").collect()] == [2]


def test_matches_begin_with_their_first_characters(spark):
    """The look-ahead before a pattern changes no match, and holds at every place where one begins."""
    assert begins_of(r"\b(?:delve|vibrant)\b|\bin\s") == ([(100, 100), (105, 105), (118, 118)], True)
    assert begins_of(r"(?:^|[.!?]\s+|\n)\s*It")[1] is False and begins_of("a?b") == ([(97, 97), (98, 98)], False)
    assert begins_of(r"[^a]b") is None and begins_of(r"(?:ab)?") is None and begins_of(r"\Wb") is None and begins_of("(") is None
    assert java_pattern(r"\bin\b|\bat\b").startswith("(?i)(?=[")
    texts = ["In x, not xin.\nIT  was dead — at", "caféin à la in_x in", "It is. 😀 it – x -- y", ""]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    for p in [r"\bin\b|\bat\b", r"(?:^|[.!?]\s+|\n)\s*it\b", r"—|\s–\s|\s--\s", r"\b\w+\s+dead\b", r"(?:\bx|é)in"]:
        word, blank = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))", r"[\s\x{00A0}\x{2003}]"
        plain = "(?i)" + p.replace(r"\b", word).replace(r"\s", blank)
        got = d.select(F.regexp_extract_all("text", F.lit(java_pattern(p)), F.lit(0)).alias("a"), F.regexp_extract_all("text", F.lit(plain), F.lit(0)).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got], p


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*WORDS, ", ", ". ", "? ", "'s ", "-", "\n"]), max_size=14))
def test_first_characters_of_the_bundled_rules(parts):
    text = " ".join(parts)
    for r in catalog.RULES:
        pattern = r["match"].get("pattern")
        if pattern is None or re.search(r"\(\?<[!=]", pattern):
            continue
        known = begins_of(pattern)
        for m in re.finditer(pattern, text) if known else ():
            assert any(a <= ord(m[0][0]) <= b for a, b in known[0]), (r["id"], text)
            assert not known[1] or not re.match(r"[A-Za-z0-9_]", text[m.start() - 1 : m.start()]), (r["id"], text)


def test_whole_words_of_patterns():
    assert whole_words_of(r"\b(?:delv(?:e|ing)|in\s+short)\b") == {"delve", "delving", "short"}
    assert whole_words_of(r"\butili[sz]e[sd]?\b") == {f"utili{a}e{b}" for a in "sz" for b in ("", "s", "d")}
    assert whole_words_of(r"\bit['’]s\b") == {"it"} and whole_words_of(r"(?:^|\n)Look\s*,") == {"look"}
    # an edge that may lie inside a longer word gives no whole word
    assert whole_words_of(r"lock") is None and whole_words_of(r"\block\w*") is None
    assert whole_words_of(r"(?:\s|x)lock\b") is None and whole_words_of(r"(?:\block\b)?") is None and whole_words_of("(") is None


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([*WORDS, ",", ".", "?", "'s", "-", "\n", " "]), max_size=14), st.sampled_from(["", " "]))
def test_a_match_holds_a_whole_word(parts, between):
    text = between.join(parts)
    tokens = set(re.findall("[a-z0-9_]+", text.lower()))
    for r in catalog.RULES:
        pattern = r["match"].get("pattern")
        if pattern is None or re.search(r"\(\?<[!=]", pattern):
            continue
        words = whole_words_of(pattern)
        if words and re.search(pattern, text, re.I | re.A):
            assert words & tokens, (r["id"], text)


def test_counts_with_and_without_words_of_the_rules(spark):
    """counts are those of the patterns alone, and a rule's needles are looked for only where one of its words is."""
    active = [r for r in catalog.PLAIN if "tests" in r]
    texts = [t for r in active for t in r["tests"]["hit"] + r["tests"]["miss"]] + ["", "Nothing here."]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    counted = R.counts(d, active)
    assert "known" in counted._jdf.queryExecution().optimizedPlan().toString()
    plain = F.array(*(F.regexp_count("text", F.lit(java_pattern(r["match"]["pattern"], "i" in r["match"].get("flags", "")))).cast("double") for r in active))
    assert counted.count() == len(texts) > 40
    assert sorted(counted.select("doc_id", "n").collect()) == sorted(d.select("doc_id", plain.alias("n")).collect())


def test_phrases_are_counted_where_their_needles_are(spark):
    """numbers are those of the pattern alone, and a needle guards it."""
    from prosemill.operators import detect

    d = spark.createDataFrame([("In order to see, IN  order to. in order to",), ("of the! of the | OF THE",), ("",)], "text string").withColumn("lowered", F.lower("text"))
    counts = d.select(*(detect.counted(F.col("text"), F.col("lowered"), p).alias(k) for k, p in catalog.PHRASES.items()))
    plain = d.select(*(F.regexp_count("text", F.lit(java_pattern(p))).alias(k) for k, p in catalog.PHRASES.items()))
    assert counts.collect() == plain.collect() and [r.in_order_to for r in counts.collect()] == [2, 0, 0]
    plan = catalog.q_regex_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(lowered" in plan
