"""Rules as data: validation R1, resolution R2-R8, content hashes R9 and conformance.

A set is {"name", "version", "aliases", "role", "rules": [...]}; a rule is
{"id", "match": {"kind", "pattern", ...}, "notable": {bounds and normalisation},
"default", "tests": {"hit": [], "miss": []}}. Sets are control data of a few
kilobytes, so they are resolved on the driver; judging documents by the resolved
rules is one projection over one scan (evaluate()).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.needles import may_match, whole_words_of
from ..functions.text import java_pattern, let, matches
from . import detect
from .spans import SPAN
from .verdict import Notable, doc_stats

COLUMN_KINDS = ("regex", "chain", "question-chain", "rhythm")
FRAME_KINDS = ("echo", "anaphora", "frame")


def notable_of(rule: dict) -> Notable:
    n = dict(rule["notable"])
    bounds = {op: float(n[op]) for op in (">", ">=", "<", "<=") if op in n}
    needs = {{"functionWords": "function_words"}.get(k, k): v for k, v in n.get("needs", {}).items()}
    return Notable(bounds, n.get("per"), n.get("power"), rule["match"]["kind"] == "rhythm", needs)


def validate(rule: dict) -> dict:
    """The rule, or ValueError for a missing id, the old shape, an unknown kind or bad bounds."""
    if not rule.get("id"):
        raise ValueError("a rule has no id")
    if "match" not in rule:
        raise ValueError(f'rule "{rule["id"]}": kind and pattern belong under match')
    if rule["match"].get("kind") not in COLUMN_KINDS + FRAME_KINDS:
        raise ValueError(f'rule "{rule["id"]}": unknown kind {rule["match"].get("kind")}')
    if not rule.get("notable"):
        raise ValueError(f'rule "{rule["id"]}": notable is missing')
    notable_of(rule)
    return rule


#: The length gates of rate rules in sets for short documents.
SHORT_DOCUMENTS = {"words": 80, "sentences": 3, "matches": 2}


def widened(pattern: str) -> str:
    """Blanks outside classes match any white space."""
    parts = re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|.", pattern, re.S)
    return "".join(r"\s+" if p == " " else p for p in parts)


def build_rule(rule: dict) -> dict:
    """A rule as written by hand, with blanks widened and rate rules without gates of their own gated, "<=" rules apart."""
    m, n = dict(rule["match"]), dict(rule["notable"])
    if "pattern" in m:
        m["pattern"] = widened(m["pattern"])
    if (n.get("per") or n.get("power")) and "<=" not in n and "needs" not in n:
        n["needs"] = dict(SHORT_DOCUMENTS)
    return rule | {"match": m, "notable": n}


def prepared(rule_set: dict) -> dict:
    """A set as written by hand, built."""
    return rule_set | {"rules": [build_rule(r) for r in rule_set["rules"]]}


def validate_set(rule_set: dict | list) -> dict:
    """A set, or a bare list of rules, with ids that differ."""
    s = {"name": "unnamed", "rules": rule_set} if isinstance(rule_set, list) else rule_set
    twice = [f"{k} ({n} times)" for k, n in Counter(r.get("id") for r in s["rules"]).items() if n > 1]
    if twice:
        raise ValueError(f"set {s['name']}: repeated ids: {', '.join(twice)}")
    for r in s["rules"]:
        validate(r)
    return s


def compare_versions(a: str, b: str) -> int:
    """-1, 0 or 1; missing parts are 0."""
    x, y = ([int(p) if p.isdigit() else 0 for p in v.split(".")] for v in (a, b))
    n = max(len(x), len(y))
    x, y = x + [0] * (n - len(x)), y + [0] * (n - len(y))
    return (x > y) - (x < y)


def content_hash(rule_set: dict) -> str:
    """The first sixteen hex digits of the rules' SHA-256."""
    return hashlib.sha256(json.dumps(rule_set["rules"], sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def resolve(sources: list[dict], select: list[str] = (), ignore: list[str] = (), everything: bool = False, tune: dict | None = None) -> list[dict]:
    """The active rules, each with its set and order. sources: sets in rising precedence; the last of a name wins."""
    by_name: dict[str, dict] = {}
    for s in sources:
        by_name.pop(s["name"], None)
        by_name[s["name"]] = validate_set(s)
    alias = {a: s["name"] for s in by_name.values() for a in s.get("aliases", []) if a not in by_name}
    ids = {r["id"] for s in by_name.values() for r in s["rules"]}
    unknown = [n for n in [*select, *ignore, *(tune or {})] if n not in by_name and n not in alias and n not in ids]
    if unknown:
        raise ValueError(f"no such rule or set: {', '.join(unknown)}")
    chosen, dropped = ([alias.get(n, n) for n in names] for names in (select, ignore))
    out = []
    for s in by_name.values():
        for r in s["rules"]:
            named = r["id"] in chosen or s["name"] in chosen
            if chosen and not named or r["id"] in dropped or s["name"] in dropped:
                continue
            if r.get("default") == "off" and not (everything or named):
                continue
            if r["id"] in (tune or {}):
                r = validate(r | {"notable": r["notable"] | tune[r["id"]], "tuned": True})
            out.append(r | {"set": s["name"], "ord": len(out)})
    styles = {r["set"] for r in out if by_name[r["set"]].get("role") == "style"}
    if len(styles) > 1:
        raise ValueError(f"more than one style is active: {', '.join(sorted(styles))}")
    return out


def merge_config(config: dict, flags: dict) -> dict:
    """A selection on the command line replaces, lists join without repeats, scalars of the command line come first."""
    out = dict(config)
    for k, v in flags.items():
        if k == "select":
            out[k] = v or config.get(k, [])
        elif isinstance(v, list):
            out[k] = list(dict.fromkeys([*config.get(k, []), *v]))
        elif v is not None:
            out[k] = v
    return out


def vocabulary_of(rule: dict, least: int = 20) -> list[str] | None:
    r"""The words of a rule that is one flat alternation \b(?:a|b|...)\b of at least `least` plain words."""
    pattern = rule["match"].get("pattern") or ""
    if rule["match"]["kind"] != "regex" or not (pattern.startswith(r"\b(?:") and pattern.endswith(r")\b")):
        return None
    words = pattern[5:-3].split("|")
    return None if len(words) < least or any(set(w) & set(r"\[]()*+?{}^$") for w in words) else words


def _tokens_suffice(rule: dict) -> list[str] | None:
    """The lower-cased words of a list whose entries are single tokens, so that looking tokens up finds what its pattern finds."""
    words = vocabulary_of(rule)
    return sorted({w.lower() for w in words}) if words and "i" in rule["match"].get("flags", "") and all(re.fullmatch(r"[A-Za-z0-9_]+", w) for w in words) else None


def run_spans(text: Column, m: dict) -> Column:
    """M4 M6 M7: runs of neighbouring sentences, as array<struct<start, stop, n, ...>>."""
    if m["kind"] == "echo":
        return detect.echo_runs(text, m.get("minGram", 4), m.get("minRun", 2), m.get("anchored") or None, m.get("minFuncWords", 0), m.get("minShare", 0))
    if m["kind"] == "anaphora":
        return detect.anaphora_runs(text, m.get("minRun", 3))
    return detect.frame_runs(text, m.get("gram", 8), m.get("minRun", 3), m.get("anchors", 2), m.get("minLetters", 13), m.get("letterRatio", 0.62))


def spans_of(rule: dict) -> Column:
    """array<SPAN> of a rule in the columns text and lowered; n is null where a match counts once. A metric has none."""
    m, text = rule["match"], F.col("text")
    nothing = F.expr(f"cast(array() as array<{SPAN}>)")
    if m["kind"] == "rhythm":
        return nothing
    if m["kind"] in FRAME_KINDS:
        found = run_spans(text, m)
    elif m["kind"] == "question-chain":
        found = F.when(F.contains(text, F.lit("?")), detect.question_chain(text, m.get("minRun", 2)))
    elif m["kind"] == "chain":
        found = detect.chain(text, m["pattern"], m["headTest"])
    else:
        found = detect.regex(text, m["pattern"], "i" in m.get("flags", ""))
        if m.get("distinct"):
            found = let(found, lambda f: let(F.transform(f, lambda o: F.lower(o["value"])), lambda low: F.filter(f, lambda o, i: F.array_position(low, F.lower(o["value"])) == i + 1)))
    count = (lambda o: F.lit(None)) if m["kind"] == "regex" else (lambda o: o["n"])
    spans = F.transform(found, lambda o: F.struct(o["start"].alias("start"), o["stop"].alias("stop"), count(o).cast("int").alias("n")))
    possible = may_match(F.col("lowered"), m["pattern"]) if m["kind"] in ("regex", "chain") else None
    return F.coalesce(spans if possible is None else F.when(possible, spans), nothing)


def in_numbers(rule: dict) -> bool:
    """Whether a rule's spans are its pattern's matches, whose lengths and gaps tell their places."""
    return rule["match"]["kind"] == "regex" and not rule["match"].get("distinct")


def lengths_of(rule: dict) -> Column:
    """array<int>: the lengths of a pattern's matches in the columns text and lowered."""
    m = rule["match"]
    lengths = F.transform(matches(F.col("text"), java_pattern(m["pattern"], "i" in m.get("flags", ""))), F.length)
    possible = may_match(F.col("lowered"), m["pattern"])
    return lengths if possible is None else F.when(possible, lengths)


def gaps_of(rule: dict, lengths: Column) -> Column:
    """array<int>: how much lies before each match, behind the one before it; only a text with a match is searched a second time."""
    m, n = rule["match"], F.size(lengths)
    gaps = F.transform(F.split(F.col("text"), java_pattern(m["pattern"], "i" in m.get("flags", "")), -1), F.length)
    # the engine leaves out the gap before an empty match at the start
    whole = lambda g: F.when(F.size(g) == n, F.concat(F.array(F.lit(0)), g)).otherwise(g)
    return F.when(n > 0, let(gaps, lambda g: F.slice(whole(g), F.lit(1), n)))


def _counted(kind: str, rule: dict, words: frozenset[str] | None = None) -> Column:
    """A rule's count; words: whole words of which every match holds one, to be looked for in the column known."""
    m, text = rule["match"], F.col("text")
    if kind == "rhythm":
        return detect.rhythm(text, m.get("minSentenceWords", 1), m.get("maxSentenceWords", 200))[0]
    if kind in FRAME_KINDS:
        return F.size(run_spans(text, m))
    if kind == "question-chain":
        return F.when(F.contains(text, F.lit("?")), F.size(detect.question_chain(text, m.get("minRun", 2)))).otherwise(0)
    if listed := _tokens_suffice(rule):
        found = F.filter("tokens", lambda w: w.isin(listed))
        return F.size(F.array_distinct(found) if m.get("distinct") else found)
    if kind == "chain":
        n = F.size(detect.chain(text, m["pattern"], m["headTest"]))
    elif m.get("distinct"):
        n = F.size(detect.distinct_matches(text, m["pattern"], "i" in m.get("flags", "")))
    else:
        n = F.regexp_count(text, F.lit(java_pattern(m["pattern"], "i" in m.get("flags", ""))))
    tests = [F.exists("known", lambda w: w.isin(sorted(words)))] if words else []
    possible = may_match(F.col("lowered"), m["pattern"])
    tests += [] if possible is None else [possible]
    return F.when(reduce(and_, tests), n).otherwise(0) if tests else n


#: From so many rules on, a text's words are found once for all of them, before the needles of each are looked for.
MANY = 8


def _gates(rule_list: list[dict]) -> list[frozenset[str] | None]:
    """Of each rule the whole words of which its matches hold one, where these are asked for first."""
    held = [whole_words_of(r["match"]["pattern"]) if r["match"]["kind"] in ("regex", "chain") and not _tokens_suffice(r) else None for r in rule_list]
    return held if sum(w is not None for w in held) >= MANY else [None] * len(held)


TERMS = "rule string, metric boolean, gt double, ge double, lt double, le double, per double, power double, words double, sentences double, share double, matches double"


def _terms(rule: dict) -> Column:
    """A rule's verdict as constants."""
    n, text = notable_of(rule), rule["id"].replace("\\", "\\\\").replace("'", "\\'")
    numbers = [*(n.bounds.get(op) for op in (">", ">=", "<", "<=")), n.per, n.power, *(n.gate(g) for g in ("words", "sentences", "function_words", "matches"))]
    names = [t.split()[0] for t in TERMS.split(", ")]
    values = [f"'{text}'", str(n.metric).lower(), *("cast(null as double)" if x is None else f"{float(x)!r}D" for x in numbers)]
    return F.expr("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in zip(names, values)) + ")")


def terms(rules: list[dict]) -> Column:
    """The rules' bounds as one constant array."""
    return F.array(*map(_terms, rules))


def with_stats(docs: DataFrame, rules: list[dict]) -> DataFrame:
    """docs with statistics, the lowered text and the sentences of the rhythm, which are counted where a rule measures them alone."""
    sentences = detect.rhythm(F.col("text"))[1] if any(r["match"]["kind"] == "rhythm" for r in rules) else F.lit(None)
    return doc_stats(docs).withColumn("lowered", F.lower("text")).withColumn("rhythm_sentences", sentences.cast("int"))


def counts(docs: DataFrame, rules: list[dict]) -> DataFrame:
    """doc_id, statistics and n, the count (or metric) of every rule in order.

    One scan serves all rules, and nothing is shuffled: each count is made once, and only in texts that hold a word
    and a needle of its pattern.
    """
    gates = _gates(rules)
    n = F.array(*(_counted(r["match"]["kind"], r, w).cast("double") for r, w in zip(rules, gates, strict=True)))
    rows = with_stats(docs, rules)
    lists = [w for w in map(_tokens_suffice, rules) if w]
    asked = [w for w in gates if w]
    if lists or asked:
        # an index of all lists' words: tokens are looked up in it once, whatever the lists' lengths, and few are left for each list
        every = sorted(set().union(*lists, *asked))
        tokens = F.transform(matches(F.col("text"), "[A-Za-z0-9_]+"), F.lower)
        rows = rows.withColumn("tokens", F.filter(tokens, lambda w: w.isin(every))).withColumn("known", F.array_distinct("tokens"))
    return rows.select("doc_id", "ws_words", "rate_words", "gate_sentences", "fn_words", "rhythm_sentences", n.alias("n"))


def verdict(t: Column, n: Column) -> Column:
    """struct<n, value, bound, limit> of a count n under the terms t, with the statistics of its row; bound is null where the rule does not fire."""
    words = F.col("rate_words").cast("double")
    plain = t["metric"] | (t["power"].isNull() & t["per"].isNull())
    # count / words * per, in this order, is what the bounds were made for
    rate = F.when(words <= 0, 0.0).when(t["power"].isNotNull(), n / F.pow(words, t["power"])).otherwise(n / words * t["per"])
    share = F.when(words > 0, F.col("fn_words") / words).otherwise(0.0)
    ok = (words >= t["words"]) & (F.col("gate_sentences") >= t["sentences"]) & (share >= t["share"]) & (t["metric"] | (n >= t["matches"]))

    def bounded(v: Column) -> Column:
        tests = [(v > t["gt"], ">", "gt"), (v >= t["ge"], ">=", "ge"), (v < t["lt"], "<", "lt"), (v <= t["le"], "<=", "le")]
        crossed = F.coalesce(*(F.when(ok & test, F.struct(F.lit(op).alias("bound"), t[limit].alias("limit"))) for test, op, limit in tests))
        return let(crossed, lambda c: F.struct(n.alias("n"), v.alias("value"), c["bound"].alias("bound"), c["limit"].alias("limit")))

    return let(F.when(plain, n).otherwise(rate), bounded)


def judged(docs: DataFrame, rules: list[dict]) -> DataFrame:
    """A1: (doc_id, k, rule, n, rate_words, sentences, value, bound, limit) of every rule (by place k) and document.

    bound is null where the rule does not fire. The rules' bounds travel as one constant array, so one expression
    judges any number of rules.
    """
    def one(t: Column, k: Column, n: Column) -> Column:
        said = lambda v: F.struct(k.alias("k"), t["rule"].alias("rule"), v["n"].alias("n"), F.col("rate_words").alias("rate_words"), F.col("rhythm_sentences").alias("sentences"), v["value"].alias("value"), v["bound"].alias("bound"), v["limit"].alias("limit"))
        return let(verdict(t, F.get(n, k)), said)

    # n is bound outside: put into the lambda by the planner, all counts would be made again for each rule
    return counts(docs, rules).select("doc_id", F.inline(let(F.col("n"), lambda n: F.transform(terms(rules), lambda t, k: one(t, k, n)))))


def evaluate(docs: DataFrame, rules: list[dict]) -> DataFrame:
    """A1: (doc_id, rule, value, bound, fires) of every rule and document."""
    return judged(docs, rules).select("doc_id", "rule", "value", "bound", F.col("bound").isNotNull().alias("fires"))


def conformance(spark, rules: list[dict]) -> DataFrame:
    """(rule, label, n, passed): the rules' own examples, evaluated without their length gates."""
    cases = [(k, r["id"], label, t) for k, (r, label, t) in enumerate((r, label, t) for r in rules for label in ("hit", "miss") for t in r.get("tests", {}).get(label, []))]
    if not cases:
        return spark.createDataFrame([], "rule string, label string, n long, passed long")
    d = spark.createDataFrame(cases, "doc_id long, of string, label string, text string")
    free = [r | {"notable": r["notable"] | {"needs": {"words": 0, "sentences": 0, "functionWords": 0, "matches": 0}}} for r in rules]
    got = evaluate(d.select("doc_id", "text"), free).join(d.select("doc_id", "of", "label"), "doc_id").where("rule = of")
    return got.groupBy("rule", "label").agg(F.count("*").alias("n"), F.sum((F.col("fires") == (F.col("label") == "hit")).cast("long")).alias("passed"))
