"""Evaluation E1-E15: rates by side, budgets, folds, sweeps, redundancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import RATE_WORD, each, first_words, let, matches


def rates_by_side(counts: DataFrame) -> DataFrame:
    """counts(rule, side, doc_id, spans, fires, words) to spans, documents hit and rate per 1000 words."""
    one = counts.withColumn("s", F.when(F.col("fires"), F.greatest(F.col("spans"), F.lit(1))).otherwise(0))
    return one.groupBy("rule", "side").agg(F.sum("s").alias("spans"), F.sum((F.col("s") > 0).cast("long")).alias("docs_hit"), F.sum("words").alias("words")).withColumn("rate", F.when(F.col("words") > 0, F.col("spans") / F.col("words") * 1000).otherwise(0.0))


def threshold_at_budget(scores: DataFrame, budget: int = 1) -> DataFrame:
    """Just above the (budget + 1)-th highest human score; how many of the other side reach it."""
    human = scores.where("side = 'human'").select("score").orderBy(F.desc("score")).limit(budget + 1)
    cut = human.agg(F.count("*").alias("k"), F.min("score").alias("m")).select(F.when(F.col("k") == budget + 1, F.col("m") + 1e-9).otherwise(0.0).alias("threshold"))
    caught = F.sum(((F.col("side") == "ai") & (F.col("score") >= F.col("threshold"))).cast("long"))
    false_ = F.sum(((F.col("side") == "human") & (F.col("score") >= F.col("threshold"))).cast("long"))
    return scores.join(F.broadcast(cut)).groupBy("threshold").agg(caught.alias("caught"), false_.alias("false_alarms"))


def folds(rows: DataFrame, k: int = 4) -> DataFrame:
    """Rows with a fold by hash of the id, the same for any number of partitions."""
    return rows.withColumn("fold", F.pmod(F.col("doc_id"), F.lit(k)).cast("int"))


def word_classes(bags: DataFrame) -> DataFrame:
    """Document frequency of words by side, lift (ai + 1) / (human + 1) and class."""
    df = bags.groupBy("word").agg(F.count(F.when(F.col("side") == "ai", 1)).alias("ai"), F.count(F.when(F.col("side") == "human", 1)).alias("human"))
    lift = (F.col("ai") + 1) / (F.col("human") + 1)
    return df.withColumn("lift", lift).withColumn("class", F.when(lift > 1.2, "ai").when(lift < 0.83, "human").otherwise("even"))


def redundant(hits: DataFrame, prefix: int = 3) -> DataFrame:
    """rule pairs (a, b) where b fires on every example of a; hits(example_rule, example, rule), repeated rows allowed.

    A containment join with prefix filtering: a rule that fires on every example of a fires on those where the fewest
    rules fire. Only rules met on all of these few (`prefix` of each a) are pairs to be counted; pairs of rules that
    merely meet somewhere are never made.
    """
    hits = hits.select("example_rule", "example", "rule").distinct()
    load = hits.groupBy("example_rule", "example").agg(F.count("*").alias("rules"))
    w = Window.partitionBy("example_rule")
    rare = load.withColumn("place", F.row_number().over(w.orderBy("rules", "example"))).withColumn("n", F.count("*").over(w)).where(F.col("place") <= prefix)
    rare = rare.select("example_rule", "example", "n")
    met = hits.where("rule <> example_rule").join(rare, ["example_rule", "example"]).groupBy("example_rule", "rule").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    pairs = met.where(F.col("k") == F.least("n", F.lit(prefix))).select("example_rule", "rule", "n")
    both = hits.join(pairs, ["example_rule", "rule"]).groupBy("example_rule", "rule").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    return both.where("k = n").select(F.col("example_rule").alias("rule_a"), F.col("rule").alias("rule_b"), "n")


def top_samples(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("doc_id"))).where(F.col("i") <= k).drop("i")


def rate_table(rates: DataFrame, docs: DataFrame) -> DataFrame:
    """One row a rule: documents hit and rate per 1000 words of either side, and what the rule is on this corpus.

    rates: rule, side, spans, docs_hit. docs: side, words. Classes: silent, clean (machine documents alone) or
    fires_on_human.
    """
    words = docs.groupBy("side").agg(F.sum("words").alias("side_words"))
    j = rates.join(F.broadcast(words), "side")  # two rows
    of = lambda c, side: F.coalesce(F.sum(F.when(F.col("side") == side, c)), F.lit(0))
    rate = F.col("spans") / F.col("side_words") * 1000
    out = j.groupBy("rule").agg(of(F.col("docs_hit"), "human").alias("human_docs"), of(F.col("docs_hit"), "ai").alias("ai_docs"), of(rate, "human").alias("human_rate"), of(rate, "ai").alias("ai_rate"))
    return out.withColumn("class", F.when(F.col("human_docs") > 0, "fires_on_human").when(F.col("ai_docs") > 0, "clean").otherwise("silent"))


def register_verdicts(rows: DataFrame) -> DataFrame:
    """By register, findings per 1000 words of either side and which side they favour; rows(register, side, spans, words)."""
    of = lambda c, side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c))), F.lit(0))
    by = rows.groupBy("register").agg(*(of(c, side).alias(f"{side}_{c}") for side in ("human", "ai") for c in ("spans", "words")))
    h, a = (F.when(F.col(f"{s}_words") > 0, F.col(f"{s}_spans") / F.col(f"{s}_words") * 1000).otherwise(0.0) for s in ("human", "ai"))
    verdict = F.when((F.col("human_words") == 0) | (F.col("ai_words") == 0), "incomplete").when(a > h * 1.5, "ai").when(a < h * 0.67, "human").otherwise("none")
    return by.select("register", h.alias("human_rate"), a.alias("ai_rate"), verdict.alias("verdict"))


def set_scorecard(hits: DataFrame, rules: DataFrame, docs: DataFrame) -> DataFrame:
    """By rule set: rules, silent ones, rates per 1000 words, their ratio and the human documents hit.

    hits: doc_id, side, rule, n (above 0). rules: rule, set. docs: side, words.
    """
    words = docs.groupBy("side").agg(F.sum("words").alias("side_words"))
    j = hits.join(F.broadcast(rules), "rule").join(F.broadcast(words), "side")
    rate = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n") / F.col("side_words") * 1000)), F.lit(0.0))
    by = j.groupBy("set").agg(F.countDistinct("rule").alias("heard"), rate("human").alias("human_rate"), rate("ai").alias("ai_rate"), F.countDistinct(F.when(F.col("side") == "human", F.col("doc_id"))).alias("human_docs"))
    out = rules.groupBy("set").agg(F.count("*").alias("rules")).join(by, "set", "left").na.fill(0)
    return out.select("set", "rules", (F.col("rules") - F.col("heard")).alias("silent"), "human_rate", "ai_rate", F.when(F.col("human_rate") > 0, F.col("ai_rate") / F.col("human_rate")).alias("ratio"), "human_docs")


def evidence(rates: DataFrame) -> DataFrame:
    """E5: rules by what their hits show: proven, noisy, even or untested; rates(rule, side, spans, docs_hit)."""
    of = lambda c, side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c))), F.lit(0))
    by = rates.groupBy("rule").agg(of("spans", "human").alias("human_hits"), of("docs_hit", "human").alias("human_docs"), of("spans", "ai").alias("ai_hits"), of("docs_hit", "ai").alias("ai_docs"))
    h, a = F.col("human_hits"), F.col("ai_hits")
    kind = F.when((h == 0) & (a == 0), "untested").when((a > 0) & ((F.col("human_docs") == 0) | (a >= 3 * h)), "proven").when(h > a, "noisy").otherwise("even")
    return by.withColumn("evidence", kind)


def list_hits(docs: DataFrame, listed: DataFrame, lengths: list[int] = (0,), max_broadcast: int = 100_000, save=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """What documents cut to their first words hold of a ranked word list.

    docs: doc_id, side, text (and other columns, kept). listed: word, rank. Two tables: (docs' columns but the text,
    length, words) of each document and length, 0 being the whole, and (doc_id, length, rank) of their list words.
    save() writes a table and reads it back; both parts are read from it.
    """
    keep = [c for c in docs.columns if c != "text"]

    some = [r.word for r in listed.where("word is not null").select("word").limit(max_broadcast + 1).collect()]  # a list is part of the rules; a longer one is joined
    inside = len(some) <= max_broadcast

    def cut(n: int) -> Column:
        def told(text: Column) -> Column:
            every = matches(F.lower(text), "[a-z][a-z'’-]*")
            found = F.array_distinct(F.filter(every, lambda w: w.isin(some)) if inside else every)
            return F.struct(F.lit(n).alias("length"), F.regexp_count(text, F.lit(RATE_WORD)).cast("long").alias("words"), found.alias("list"))

        return let(first_words(F.col("text"), n) if n else F.col("text"), told)

    # a table: texts are cut and taken apart once, however often both parts are read
    rows = save(docs.select(*keep, F.explode(F.array(*map(cut, lengths))).alias("c")).select(*keep, "c.*"))
    small = F.broadcast(listed) if inside else listed
    hits = rows.select("doc_id", "length", F.explode(each("list")).alias("word")).join(small, "word").select("doc_id", "length", "rank")
    return rows.drop("list"), hits


def at_budget(scores: DataFrame, *by: str, budget: int = 1) -> DataFrame:
    """E6 by group: by, threshold (just above the (budget + 1)-th highest human score), caught and false_alarms; scores(by, side, score)."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"))
    human = scores.where("side = 'human'").select(*by, "score").withColumn("k", F.row_number().over(w)).where(F.col("k") <= budget + 1)
    cut = human.groupBy(*by).agg((F.min("score") + 1e-9).alias("threshold"))
    reach = F.col("score") >= F.col("threshold")
    # one row a group
    return scores.join(F.broadcast(cut), list(by)).groupBy(*by, "threshold").agg(F.sum(((F.col("side") == "ai") & reach).cast("long")).alias("caught"), F.sum(((F.col("side") == "human") & reach).cast("long")).alias("false_alarms"))


def scored(docs: DataFrame, hits: DataFrame, variants: dict[str, Column], power: float = 0.7) -> DataFrame:
    """(variant, docs' columns, score): different list words that a variant keeps, over words to the power."""
    counts = hits.groupBy("doc_id", "length").agg(*(F.sum(keep.cast("long")).alias(f"v{k}") for k, keep in enumerate(variants.values())))
    j = docs.join(counts, ["doc_id", "length"], "left")
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("variant"), F.coalesce(f"v{k}", F.lit(0)).alias("n")) for k, name in enumerate(variants)))).alias("v")
    return j.select(*docs.columns, each).select(*docs.columns, "v.variant", F.when(F.col("words") > 0, F.col("v.n") / F.pow(F.col("words").cast("double"), F.lit(power))).otherwise(0.0).alias("score"))


def size_sweep(docs: DataFrame, hits: DataFrame, sizes: list[int], power: float = 0.7, budget: int = 1) -> DataFrame:
    """Threshold at the budget and what it catches, for the first n words of the list."""
    rows = scored(docs, hits, {str(n): F.col("rank") <= n for n in sizes}, power)
    return at_budget(rows.select(F.col("variant").cast("int").alias("size"), "side", "score"), "size", budget=budget)


def ablation(docs: DataFrame, hits: DataFrame, variants: dict[str, Column], power: float = 0.7, budget: int = 1) -> DataFrame:
    """The same for lists without some words, at each length; variants: the condition on rank that keeps a word."""
    return at_budget(scored(docs, hits, variants, power).select("variant", "length", "side", "score"), "variant", "length", budget=budget)


def exponents(docs: DataFrame, hits: DataFrame, betas: list[float], budget: int = 1) -> DataFrame:
    """A threshold set on whole documents for each exponent, applied to cut ones: (beta, length, caught, false_alarms)."""
    n = hits.groupBy("doc_id", "length").agg(F.count("*").alias("n"))
    j = docs.join(n, ["doc_id", "length"], "left").select("side", "length", "words", F.coalesce("n", F.lit(0)).alias("n"))
    value = lambda b: F.when(F.col("words") > 0, F.col("n") / F.pow(F.col("words").cast("double"), F.lit(b))).otherwise(0.0)
    rows = j.select("side", "length", F.explode(F.array(*(F.struct(F.lit(b).alias("beta"), value(b).alias("score")) for b in betas))).alias("v")).select("side", "length", "v.*")
    cut = at_budget(rows.where("length = 0").select("beta", "side", "score"), "beta", budget=budget).select("beta", "threshold")
    reach = F.col("score") >= F.col("threshold")
    return rows.join(F.broadcast(cut), "beta").groupBy("beta", "length").agg(F.sum(((F.col("side") == "ai") & reach).cast("long")).alias("caught"), F.sum(((F.col("side") == "human") & reach).cast("long")).alias("false_alarms"))


def margin(scores: DataFrame, threshold: float, *by: str) -> DataFrame:
    """How many standard deviations of the human scores lie between the highest of them and the threshold."""
    human = scores.where("side = 'human'").groupBy(*by).agg(F.max("score").alias("top"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.count("*").alias("n"))
    return human.select(*by, "n", "top", "mean", "sd", F.try_divide(F.lit(threshold) - F.col("top"), "sd").alias("margin"))


def holdout_sizes(docs: DataFrame, hits: DataFrame, sizes: list[int], k: int = 4, power: float = 0.7, budget: int = 1) -> DataFrame:
    """The list size that catches most on the other folds, judged on each fold: (fold, size, threshold, caught, total).

    docs has a fold column; of equal sizes the shorter list is taken.
    """
    rows = scored(docs, hits, {str(n): F.col("rank") <= n for n in sizes}, power).select(F.col("variant").cast("int").alias("size"), "fold", "side", "score")
    train = rows.select("size", "side", "score", F.explode(F.filter(F.array(*map(F.lit, range(k))), lambda f: f != F.col("fold"))).alias("fold"))
    found = at_budget(train, "fold", "size", budget=budget)
    best = found.groupBy("fold").agg(F.max(F.struct("caught", (-F.col("size")).alias("neg"), "threshold")).alias("b")).select("fold", (-F.col("b.neg")).alias("size"), "b.threshold")
    test = rows.where("side = 'ai'").join(F.broadcast(best), ["fold", "size"])
    return test.groupBy("fold", "size", "threshold").agg(F.sum((F.col("score") >= F.col("threshold")).cast("long")).alias("caught"), F.count("*").alias("total"))


def selector_backtest(fits: DataFrame, caught: DataFrame) -> DataFrame:
    """By fit, the cluster whose words catch most, those the two selectors pick, and whether they are right.

    fits: k, cluster, stamped, end_share, arrived. caught: k, cluster, caught.
    """
    from .corpus import judge_fits

    best = caught.groupBy("k").agg(F.max(F.struct("caught", (-F.col("cluster")).alias("neg"))).alias("b")).select("k", (-F.col("b.neg")).alias("truth"), F.col("b.caught").alias("caught"))
    j = judge_fits(fits).join(best, "k")
    return j.select("k", "truth", "caught", "signature", "growth", "gap", (F.col("signature") == F.col("truth")).alias("signature_right"), F.coalesce(F.col("growth") == F.col("truth"), F.lit(False)).alias("growth_right"))


#: A number with what qualifies it and what it counts: "over 1,200 documents", "about **40% signed**", "7 sides".
CLAIM = r"(?i)(?:(?<![A-Za-z])(over|at least|about|around|roughly)\s+)?(?:\*\*(over|about|around)\s+)?\**(?<![0-9.,])([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)(%?)\**\s+([a-z]+(?:[ -][a-z]+){0,3})"
#: A floor must still be true and not so low that it misleads; a figure given as about may be off by so much (of points for a share).
MISLEADS, ABOUT = 1.6, 5.0


def read_claims(texts: DataFrame) -> DataFrame:
    """(file, kind, stated, unit, words) of every number with a subject in (file, text); kind: floor, about or exact."""
    flat = F.regexp_replace("text", r"\s+", " ")  # texts are wrapped anywhere
    part = lambda k: F.regexp_extract_all(flat, F.lit(CLAIM), F.lit(k))
    found = texts.select("file", F.inline(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("n"), part(4).alias("unit"), part(5).alias("words"))))
    how = F.lower(F.concat("a", "b"))
    kind = F.when(how.rlike("over|least"), "floor").when(how != "", "about").otherwise("exact")
    return found.select("file", kind.alias("kind"), F.regexp_replace("n", ",", "").cast("double").alias("stated"), "unit", F.lower("words").alias("words"))


def checked_claims(texts: DataFrame, values: DataFrame, of: str | None = None) -> DataFrame:
    """(file, subject, kind, stated, value, ok): figures in texts against recomputed ones.

    values: subject, as texts put it ("documents", "% signed pages"), and value; with `of`, a column that names the file
    for which the value holds. A claim belongs to the longest subject with which its words begin. Claims about other
    things are no concern of ours.
    """
    subjects = values.withColumn("unit", F.when(F.col("subject").startswith("%"), "%").otherwise("")).withColumn("name", F.lower(F.trim(F.regexp_replace("subject", "^%", ""))))
    # a subject's first word is what a claim joins by; the rest is looked at after
    head = lambda c: F.split(c, "[ -]")[0]
    subjects = subjects.select("unit", "name", "subject", "value", head("name").alias("head"), *([F.col(of).alias("file")] if of else []))
    j = read_claims(texts).withColumn("head", head("words")).join(subjects, ["unit", "head", *(["file"] if of else [])])
    j = j.where(F.concat("words", F.lit(" ")).startswith(F.concat("name", F.lit(" "))))
    keys = ["file", "kind", "stated", "unit", "words"]
    best = j.groupBy(*keys).agg(F.max_by(F.struct("subject", "value"), F.length("name")).alias("b")).select(*keys, "b.subject", "b.value")
    v, said = F.col("value"), F.col("stated")
    ok = F.when(F.col("kind") == "floor", (v >= said) & (v < said * MISLEADS)).when(F.col("kind") == "about", F.abs(v - said) <= F.when(F.col("unit") == "%", ABOUT).otherwise(said * ABOUT / 100)).otherwise(v == said)
    return best.select("file", "subject", "kind", "stated", "value", F.coalesce(ok, F.lit(False)).alias("ok"))


def unstated(texts: DataFrame, values: DataFrame) -> DataFrame:
    """Values that no text states."""
    return values.join(checked_claims(texts, values).select("subject").distinct(), "subject", "left_anti")


# Words that let a finding stand; a suggestion is to say what to write instead.
PERMISSION = r"(?i)\b(fine in|fine when|nothing (here )?is wrong|no need to|acceptable as|leave (it|them) (alone|as)|is optional|fit judgement, not a defect|if you do not)\b"


def governance(rules: DataFrame) -> DataFrame:
    """(set, rule, problem) of suggestions that let a finding stand and of rules that are off without a reason.

    rules: set, role, rule, suggest, default, off_because. A style set, or one that is off as a whole, gives no reasons.
    """
    opted = rules.groupBy("set").agg((F.max(F.coalesce((F.col("role") == "style").cast("int"), F.lit(0))) + F.min((F.coalesce("default", F.lit("on")) == "off").cast("int")) > 0).alias("opt_in"))
    j = rules.join(F.broadcast(opted), "set")
    problems = F.array(F.when(F.col("suggest").rlike(PERMISSION), F.lit("suggestion permits")), F.when(~F.col("opt_in") & (F.col("default") == "off") & (F.coalesce(F.trim("off_because"), F.lit("")) == ""), F.lit("off without a reason")))
    return j.select("set", "rule", F.explode(F.array_compact(problems)).alias("problem"))
