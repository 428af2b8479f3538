"""Queries of the evaluation: rule tables by side, word-list sweeps, ablation, margins, back-tests.

labels.quality tells the sides apart. The word list is the 250 words that most labelled documents hold, so some lean to
either side; scores are different list words over words to the power 0.7.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import RATE_WORD, matches
from ..operators import bands, corpus, evaluate
from ..operators import rules as rule_sets
from ..sources.files import saved
from .catalog import LIFT_SQL, PHRASES, SIDE_SQL, STATS, D, bags, docs, lifted, lowered, million, phrase_count, query, read, sides

RATE = RATE_WORD.replace("'", "''")
SETS = {k: "marks" if k in ("exclamation", "table_mark", "percent_run") else "phrases" for k in PHRASES}


def rule_hits(spark, sf_dir):
    """(doc_id, side, lang, rule, n) with n above 0, every phrase rule in one scan."""
    found = F.array(*(F.struct(F.lit(k).alias("rule"), phrase_count(p).cast("long").alias("n")) for k, p in PHRASES.items()))
    return lowered(sides(spark, sf_dir)).select("doc_id", "side", "lang", F.explode(found).alias("r")).select("doc_id", "side", "lang", "r.*").where("n > 0")


def rates(spark, sf_dir):
    """Every rule and side, zeros included."""
    by = rule_hits(spark, sf_dir).groupBy("rule", "side").agg(F.sum("n").alias("spans"), F.count("*").alias("docs_hit"))
    grid = spark.createDataFrame([(k, s) for k in PHRASES for s in ("human", "ai")], "rule string, side string")
    return grid.join(by, ["rule", "side"], "left").na.fill(0)


def words_by_document(spark, sf_dir):
    return sides(spark, sf_dir).select("doc_id", "side", "lang", F.regexp_count("text", F.lit(RATE_WORD)).cast("long").alias("words"))


HITS_SQL = f"{D}, {SIDE_SQL}, sl as (select side.*, documents.lang from side join documents using (doc_id)), rl(rule, p, st) as (values " + ", ".join(f"('{k}', '(?i){p}', '{SETS[k]}')" for k, p in PHRASES.items()) + f""" ),
w as (select doc_id, side, lang, len(regexp_extract_all(text, '{RATE}')) words from sl), sw as (select side, sum(words) sw from w group by 1),
""" + "h0 as (" + " union all ".join(f"select doc_id, side, lang, '{k}' as rule, len(regexp_extract_all(text, '(?i){p}')) n from sl" for k, p in PHRASES.items()) + """), h as (select * from h0 where n > 0),
rt as (select rule, sum(n) filter (side = 'human') hs, sum(n) filter (side = 'ai') as "as", count(*) filter (side = 'human' and n > 0) hd, count(*) filter (side = 'ai' and n > 0) ad from h0 group by rule)"""


@query("rule_classes", f"with {HITS_SQL} select rule, hd human_docs, ad ai_docs, cast(floor(coalesce(hs, 0) / (select sw from sw where side = 'human') * 1e9 + 0.5) as bigint) human_rate_millionths, cast(floor(coalesce(\"as\", 0) / (select sw from sw where side = 'ai') * 1e9 + 0.5) as bigint) ai_rate_millionths, case when hd > 0 then 'fires_on_human' when ad > 0 then 'clean' else 'silent' end as \"class\" from rt")
def q_rule_classes(spark, sf_dir):
    """Rates of every rule on either side; which fire on human prose, which on machine prose alone, which never."""
    t = evaluate.rate_table(rates(spark, sf_dir), words_by_document(spark, sf_dir))
    return t.select("rule", "human_docs", "ai_docs", million(F.col("human_rate")).alias("human_rate_millionths"), million(F.col("ai_rate")).alias("ai_rate_millionths"), "class")


@query("register_verdicts", f"""with {HITS_SQL}, sp as (select lang, side, sum(n) spans from h group by all), x as (select w.lang, w.side, sum(words) words, any_value(spans) spans from w left join sp on sp.lang = w.lang and sp.side = w.side group by all),
y as (select lang as register, coalesce(sum(words) filter (side = 'human'), 0) hw, coalesce(sum(words) filter (side = 'ai'), 0) aw, coalesce(sum(spans) filter (side = 'human'), 0) h, coalesce(sum(spans) filter (side = 'ai'), 0) a from x group by lang),
z as (select register, hw, aw, case when hw > 0 then h / hw * 1000 else 0 end hr, case when aw > 0 then a / aw * 1000 else 0 end ar from y)
select register, cast(floor(hr * 1e6 + 0.5) as bigint) human_rate_millionths, cast(floor(ar * 1e6 + 0.5) as bigint) ai_rate_millionths, case when hw = 0 or aw = 0 then 'incomplete' when ar > hr * 1.5 then 'ai' when ar < hr * 0.67 then 'human' else 'none' end verdict from z""")
def q_registers(spark, sf_dir):
    """Findings per 1000 words by register and side, and the side they favour."""
    spans = rule_hits(spark, sf_dir).groupBy("doc_id").agg(F.sum("n").alias("spans"))
    rows = words_by_document(spark, sf_dir).join(spans, "doc_id", "left").select(F.col("lang").alias("register"), "side", F.coalesce("spans", F.lit(0)).alias("spans"), "words")
    return evaluate.register_verdicts(rows).select("register", million(F.col("human_rate")).alias("human_rate_millionths"), million(F.col("ai_rate")).alias("ai_rate_millionths"), "verdict")


@query("set_scorecard", f"""with {HITS_SQL}, g as (select st, count(distinct rule) heard, coalesce(sum(n / sw * 1000) filter (side = 'human'), 0) hr, coalesce(sum(n / sw * 1000) filter (side = 'ai'), 0) ar, count(distinct doc_id) filter (side = 'human') hd from h join rl using (rule) join sw using (side) group by st)
select rl.st as "set", count(*) rules, count(*) - any_value(coalesce(heard, 0)) silent, cast(floor(any_value(coalesce(hr, 0)) * 1e6 + 0.5) as bigint) human_rate_millionths, cast(floor(any_value(coalesce(ar, 0)) * 1e6 + 0.5) as bigint) ai_rate_millionths, any_value(coalesce(hd, 0)) human_docs from rl left join g using (st) group by rl.st""")
def q_sets(spark, sf_dir):
    """The scorecard of each rule set."""
    rules = spark.createDataFrame(list(SETS.items()), "rule string, `set` string")
    t = evaluate.set_scorecard(rule_hits(spark, sf_dir), rules, words_by_document(spark, sf_dir))
    return t.select("set", "rules", "silent", million(F.col("human_rate")).alias("human_rate_millionths"), million(F.col("ai_rate")).alias("ai_rate_millionths"), "human_docs")


@query("evidence_classes", f"with {HITS_SQL} select rule, cast(coalesce(hs, 0) as bigint) human_hits, hd human_docs, cast(coalesce(\"as\", 0) as bigint) ai_hits, ad ai_docs, case when coalesce(hs, 0) = 0 and coalesce(\"as\", 0) = 0 then 'untested' when \"as\" > 0 and (hd = 0 or \"as\" >= 3 * coalesce(hs, 0)) then 'proven' when coalesce(hs, 0) > coalesce(\"as\", 0) then 'noisy' else 'even' end evidence from rt")
def q_evidence(spark, sf_dir):
    """E5: what the labelled documents prove about each rule."""
    return evaluate.evidence(rates(spark, sf_dir))


@query("rule_samples", f"with {HITS_SQL}, r as (select rule, side, doc_id, n, row_number() over (partition by rule, side order by doc_id) k from h) select rule, side, doc_id, n from r where k <= case when side = 'human' then 3 else 1 end")
def q_samples(spark, sf_dir):
    """Three human documents and a machine one that each rule fires on (the limit is the report)."""
    hits = rule_hits(spark, sf_dir).select("rule", "side", "doc_id", "n")
    return evaluate.top_samples(hits.where("side = 'human'"), 3, "rule").unionByName(evaluate.top_samples(hits.where("side = 'ai'"), 1, "rule"))


# ------------------------------------------------------------------ word lists

LENGTHS, SIZES, BETAS = [0, 200, 100, 50], [50, 100, 150, 200, 250], [0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
# Own list for the ablation: words of counting in four languages.
NUMBERS = "one two three four five six seven eight nine ten un deux trois zwei drei dos tres".split()


def word_list(spark, sf_dir):
    """word, rank, and its documents on either side: the 250 words in most labelled documents."""
    t = sides(spark, sf_dir).select("side", F.explode(F.array_distinct(matches(F.lower("text"), "[a-z][a-z'’-]*"))).alias("word"))
    by = t.groupBy("word").agg(F.count(F.when(F.col("side") == "ai", 1)).alias("ai"), F.count(F.when(F.col("side") == "human", 1)).alias("human"))
    return by.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.col("ai") + F.col("human")), "word"))).where("rank <= 250")


def listed(spark, sf_dir, lengths=(0,)):
    words = saved(word_list(spark, sf_dir), "word-list")  # 250 rows, made of all texts
    labelled = sides(spark, sf_dir).select("doc_id", "side", F.pmod("doc_id", F.lit(4)).cast("int").alias("fold"), "text")
    return words, *evaluate.list_hits(labelled, words.select("word", "rank"), lengths, save=lambda df: saved(df, "cut-lists"))


def head(n: int) -> str:
    return f"regexp_extract(text, '^(?:[ \\t\\n\\x0B\\f\\r]*[^ \\t\\n\\x0B\\f\\r]+){{0,{n}}}')" if n else "text"


def list_sql(lengths) -> str:
    cut = " union all ".join(f"select doc_id, side, {n} as len_, {head(n)} as text from side" for n in lengths)
    return f"""{D}, {SIDE_SQL}, t0 as (select doc_id, side, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z''’-]*'))) word from side), cl as (select word, count(*) filter (side = 'ai') ai, count(*) filter (side = 'human') human from t0 group by word),
li as (select *, row_number() over (order by ai + human desc, word) rk from cl qualify rk <= 250), ct as ({cut}), dw as (select doc_id, side, len_, len(regexp_extract_all(text, '{RATE}')) words from ct),
hi as (select doc_id, side, len_, rk from (select doc_id, side, len_, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z''’-]*'))) word from ct) join li using (word))"""


def budget_sql(scores: str, by: str) -> str:
    """CTEs th and bu over the CTE `scores` (by, side, score)."""
    return f"hk as (select {by}, score, row_number() over (partition by {by} order by score desc) k from {scores} where side = 'human'), th as (select {by}, min(score) + 1e-9 th from hk where k <= 2 group by {by}), bu as (select {by}, th, count(*) filter (side = 'ai' and score >= th) caught, count(*) filter (side = 'human' and score >= th) false_alarms from {scores} join th using ({by}) group by {by}, th)"


@query("list_size_sweep", f"with {list_sql([0])}, sz as (select unnest({SIZES}) size), sc as (select size, dw.side, case when any_value(words) > 0 then count(rk) filter (rk <= size) / pow(any_value(words), 0.7) else 0 end score from dw cross join sz left join hi using (doc_id) group by size, doc_id, dw.side), {budget_sql('sc', 'size')} select size, cast(floor(th * 1e6 + 0.5) as bigint) threshold_millionths, caught, false_alarms from bu")
def q_sizes(spark, sf_dir):
    """The threshold at one false alarm and what it catches, for the first n words of the list."""
    _, rows, hits = listed(spark, sf_dir)
    return evaluate.size_sweep(rows, hits, SIZES).select("size", million(F.col("threshold")).alias("threshold_millionths"), "caught", "false_alarms")


NUMBERS_SQL = ", ".join(f"'{w}'" for w in NUMBERS)
VARIANT_SQL = {"all": "true", "no_numbers": f"word not in ({NUMBERS_SQL})", "no_human": "(ai + 1) / (human + 1) >= 0.83", "no_human_or_flat": "(ai + 1) / (human + 1) > 1.2"}


@query("list_ablation", f"with {list_sql(LENGTHS)}, vr as (" + " union all ".join(f"select '{v}' as variant, rk from li where {c}" for v, c in VARIANT_SQL.items()) + f"), vs(variant) as (values ('all'), ('no_numbers'), ('no_human'), ('no_human_or_flat')), vh as (select variant, doc_id, len_, count(*) n from hi join vr using (rk) group by all), sc as (select variant, len_, side, case when words > 0 then coalesce(n, 0) / pow(words, 0.7) else 0 end score from dw cross join vs left join vh using (variant, doc_id, len_)), {budget_sql('sc', 'variant, len_')} select variant, cast(len_ as int) as \"length\", caught, false_alarms from bu")
def q_ablation(spark, sf_dir):
    """The list without some of its words, on documents cut to their first words."""
    words, rows, hits = listed(spark, sf_dir, LENGTHS)
    lift = (F.col("ai") + 1) / (F.col("human") + 1)
    keep = words.select("rank", (~F.col("word").isin(NUMBERS)).alias("no_numbers"), (lift >= 0.83).alias("no_human"), (lift > 1.2).alias("no_human_or_flat"))
    marked = hits.join(F.broadcast(keep), "rank")  # 250 rows
    variants = {"all": F.lit(True)} | {v: F.col(v) for v in ("no_numbers", "no_human", "no_human_or_flat")}
    return evaluate.ablation(rows, marked, variants).select("variant", "length", "caught", "false_alarms")


@query("exponent_lengths", f"with {list_sql(LENGTHS)}, be as (select unnest({BETAS})::double beta), hn as (select doc_id, len_, count(*) n from hi group by all), sc as (select beta, len_, side, case when words > 0 then coalesce(n, 0) / pow(words, beta) else 0 end score from dw cross join be left join hn using (doc_id, len_)), fu as (select * from sc where len_ = 0), {budget_sql('fu', 'beta')} select beta, cast(len_ as int) as \"length\", count(*) filter (side = 'ai' and score >= th) caught, count(*) filter (side = 'human' and score >= th) false_alarms from sc join th using (beta) group by beta, len_")
def q_exponents(spark, sf_dir):
    """Thresholds set on whole documents for each exponent, applied to cut ones."""
    _, rows, hits = listed(spark, sf_dir, LENGTHS)
    return evaluate.exponents(rows, hits, BETAS)


@query("human_margin", f"with {list_sql([0])}, hn as (select doc_id, count(*) n from hi group by all), sc as (select side, case when words > 0 then coalesce(n, 0) / pow(words, 0.7) else 0 end score from dw left join hn using (doc_id) where side = 'human') select count(*) n, cast(floor(max(score) * 1e6 + 0.5) as bigint) top_millionths, cast(floor(avg(score) * 1e5 + 0.5) as bigint) mean_1e5, cast(floor(stddev_pop(score) * 1e5 + 0.5) as bigint) sd_1e5, cast(floor((3.0 - max(score)) / stddev_pop(score) * 1e4 + 0.5) as bigint) margin_1e4 from sc")
def q_margin(spark, sf_dir):
    """How many standard deviations of the human scores lie between the highest of them and a threshold of 3."""
    _, rows, hits = listed(spark, sf_dir)
    m = evaluate.margin(evaluate.scored(rows, hits, {"all": F.lit(True)}), 3.0)
    at = lambda c, n: F.floor(F.col(c) * n + 0.5).cast("long")
    return m.select("n", at("top", 1e6).alias("top_millionths"), at("mean", 1e5).alias("mean_1e5"), at("sd", 1e5).alias("sd_1e5"), at("margin", 1e4).alias("margin_1e4"))


@query("holdout_sizes", f"with {list_sql([0])}, sz as (select unnest({SIZES}) size), fo as (select unnest([0, 1, 2, 3]) fold), s0 as (select size, doc_id % 4 own, dw.side, case when any_value(words) > 0 then count(rk) filter (rk <= size) / pow(any_value(words), 0.7) else 0 end score from dw cross join sz left join hi using (doc_id) group by size, doc_id, dw.side), sc as (select fold, size, side, score from s0, fo where own <> fold), {budget_sql('sc', 'fold, size')}, pk as (select fold, size, th, row_number() over (partition by fold order by caught desc, size) r from bu) select cast(pk.fold as int) fold, pk.size, cast(floor(th * 1e6 + 0.5) as bigint) threshold_millionths, count(*) filter (score >= th) caught, count(*) total from pk join s0 on pk.r = 1 and s0.own = pk.fold and s0.size = pk.size and s0.side = 'ai' group by all")
def q_holdout(spark, sf_dir):
    """The list size chosen on three folds, judged on the fourth."""
    _, rows, hits = listed(spark, sf_dir)
    t = evaluate.holdout_sizes(rows, hits, SIZES)
    return t.select("fold", "size", million(F.col("threshold")).alias("threshold_millionths"), "caught", "total")


CLUSTERS = {"de": 0, "en": 1, "es": 2, "fr": 3}


@query("selector_backtest", LIFT_SQL + f""", {SIDE_SQL}, tw as (select lang, word, "rank" from k where "rank" <= 100), hs as (select bag.doc_id, tw.lang, count(*) n from bag join tw using (word) group by all),
lg(lang, cl) as (values ('de', 0), ('en', 1), ('es', 2), ('fr', 3)), dw as (select doc_id, side, len(regexp_extract_all(text, '{RATE}')) words from side), sc as (select lg.lang, side, case when words > 0 then coalesce(n, 0) / pow(words, 0.7) else 0 end score from dw cross join lg left join hs on hs.doc_id = dw.doc_id and hs.lang = lg.lang), {budget_sql('sc', 'lang')},
fi as (select d.lang, avg((side.side = 'ai')::int) stamped, avg((side.doc_id % 3 = 0)::int) s, avg((side.doc_id % 3 = 2)::int) e from side join d using (doc_id) group by d.lang),
tr as (select arg_max(cl, {{'c': caught, 'n': -cl}}) truth, max(caught) caught from bu join lg using (lang)), sg as (select arg_max(cl, {{'s': stamped, 'n': -cl}}) signature from fi join lg using (lang)), gr as (select arg_max(cl, {{'e': e, 'n': -cl}}) growth from fi join lg using (lang) where e > s)
select cast(4 as int) as k, cast(truth as int) truth, caught, cast(signature as int) signature, cast(growth as int) growth, signature = truth signature_right, coalesce(growth = truth, false) growth_right from tr, sg, gr""")
def q_backtest(spark, sf_dir):
    """With languages for clusters, whose words catch most, and whether the two selectors would have picked it."""
    number = F.create_map(*(F.lit(x) for pair in CLUSTERS.items() for x in pair))
    tops = lifted(spark, sf_dir).where("rank <= 100").select("lang", "word")
    held = bags(spark, sf_dir).select("doc_id", "word").join(F.broadcast(tops), "word").groupBy("doc_id", "lang").agg(F.count("*").alias("n"))  # 400 rows
    rows = words_by_document(spark, sf_dir).drop("lang").select("doc_id", "side", "words", F.explode(F.array(*map(F.lit, CLUSTERS))).alias("lang")).join(held, ["doc_id", "lang"], "left")
    score = F.when(F.col("words") > 0, F.coalesce("n", F.lit(0)) / F.pow(F.col("words").cast("double"), F.lit(0.7))).otherwise(0.0)
    caught = evaluate.at_budget(rows.select("lang", "side", score.alias("score")), "lang").select(F.lit(4).alias("k"), number[F.col("lang")].alias("cluster"), "caught")
    by = sides(spark, sf_dir).groupBy("lang").agg(F.avg((F.col("side") == "ai").cast("int")).alias("stamped"), F.avg((F.pmod("doc_id", F.lit(3)) == 0).cast("int")).alias("start_share"), F.avg((F.pmod("doc_id", F.lit(3)) == 2).cast("int")).alias("end_share"))
    fit = by.select(F.lit(4).alias("k"), number[F.col("lang")].alias("cluster"), "stamped", "end_share", (F.col("end_share") > F.col("start_share")).alias("arrived"))
    return evaluate.selector_backtest(fit, caught).drop("gap")


STATED = """'We hold over ' || {k} || ' documents, about **' || {p} || '% labelled** of them,' || chr(10) || 'in ' || {l} || ' languages.'"""


@query("documented_claims", f"""with {D}, a as (select source, d.doc_id, lang, l.doc_id is not null there, d.doc_id < (select max(doc_id) * 9 / 10 from d) then_ from d left join labels l using (doc_id)),
s as (select source, count(*) n, cast(floor(count(*) filter (there) * 100.0 / count(*) + 0.5) as bigint) p, count(distinct lang) l, count(*) filter (then_) n0, cast(floor(count(*) filter (there and then_) * 100.0 / greatest(count(*) filter (then_), 1) + 0.5) as bigint) p0, count(distinct lang) filter (then_) l0 from a where source is not null group by source),
c as (select source, 'documents' subject, 'floor' kind, n0 - n0 % 10 stated, n as v from s union all select source, '% labelled', 'about', p0, p from s union all select source, 'languages', 'exact', l0, l from s)
select source, subject, kind, cast(stated as double) stated, cast(v as double) as "value", case kind when 'floor' then v >= stated and v < stated * 1.6 when 'about' then abs(v - stated) <= 5 else v = stated end ok from c""")
def q_claims(spark, sf_dir):
    """A statement about each source, as it was when nine tenths of the documents were there, against what holds now."""
    lab = read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("there", F.lit(True))
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").where("source is not null").join(lab, "doc_id", "left")
    last = read(spark, sf_dir, "documents").agg(F.max("doc_id").alias("last"))
    then_ = F.col("doc_id") < F.col("last") * 9 / 10
    n = lambda c, *w: F.count(F.when(reduce(and_, [c, *w]), 1))
    share = lambda some, all_: F.floor(some * 100.0 / F.greatest(all_, F.lit(1)) + 0.5)
    there, any_ = F.coalesce("there", F.lit(False)), F.lit(True)
    by = d.join(F.broadcast(last)).groupBy("source").agg(n(any_).alias("n"), n(there).alias("t"), F.countDistinct("lang").alias("l"), n(then_).alias("n0"), n(there, then_).alias("t0"), F.countDistinct(F.when(then_, F.col("lang"))).alias("l0"))
    by = by.select("source", "n", "l", "l0", share(F.col("t"), F.col("n")).alias("p"), (F.col("n0") - F.col("n0") % 10).alias("k"), share(F.col("t0"), F.col("n0")).alias("p0"))
    texts = by.select(F.col("source").alias("file"), F.expr(STATED.format(k="cast(k as string)", p="cast(p0 as string)", l="cast(l0 as string)").replace("chr(10)", "'\\n'")).alias("text"))
    values = by.select("source", F.expr("stack(3, 'documents', cast(n as double), '% labelled', cast(p as double), 'languages', cast(l as double)) as (subject, value)"))
    return evaluate.checked_claims(texts, values, of="source").withColumnRenamed("file", "source")


@query("style_bands", f"""with {STATS}, e as (select doc_id, lang, 'comma' metric, case when rate_words > 0 then len(regexp_extract_all(text, ',')) / rate_words * 1000 end x from st union all select doc_id, lang, 'sentence-length', case when rate_words > 0 then gate_sentences / rate_words * 1000 end from st) select lang, metric, count(*) n, true lo_ok, true hi_ok from e where x is not null group by all""")
def q_bands(spark, sf_dir):
    """V5: the band of two style metrics in each language, by merged sketches of its sources, and whether its bounds lie at their ranks."""
    rates = saved(bands.style_rates(docs(spark, sf_dir, "lang", "source"), "lang", "source", metrics=("comma", "sentence-length")).where("value is not null"), "style-rates")
    found = bands.bands(bands.merged(bands.sketches(rates, "lang", "source"), "lang"), 0.1, 0.9)
    found = found.select(F.col("lang").alias("of"), F.col("metric").alias("measure"), "lo", "hi")  # a row a language and metric
    j = rates.join(F.broadcast(found), (F.col("metric") == F.col("measure")) & F.col("lang").eqNullSafe(F.col("of")))
    share = lambda c: F.sum(c.cast("long")) / F.count("*")
    held = lambda c, p: (share(F.col("value") < F.col(c)) <= p + bands.OFF) & (share(F.col("value") <= F.col(c)) >= p - bands.OFF)
    return j.groupBy("lang", "metric").agg(F.count("*").alias("n"), held("lo", 0.1).alias("lo_ok"), held("hi", 0.9).alias("hi_ok"))


DENSITY_SQL = {"commas": (",", "x <= 20"), "parentheses": ("[(]", "x <= 0"), "sentence-endings": (None, "x <= 20"), "em-dashes": ("—", "x >= 35")}


@query("density_verdicts", f"with {STATS} " + " union all ".join(f"(select doc_id, '{k}' as rule, cast(floor(x * 1e6 + 0.5) as bigint) value_millionths from (select doc_id, {'gate_sentences' if p is None else f'len(regexp_extract_all(text, {chr(39)}{p}{chr(39)}))'} / rate_words * 1000 x from st where rate_words >= 250 and gate_sentences >= 5 and fn_words / rate_words >= 0.12) where {test})" for k, (p, test) in DENSITY_SQL.items()))
def q_density(spark, sf_dir):
    """V3: documents whose density of commas, parentheses, sentence endings or em dashes is out of the measured bounds."""
    held = [r for r in bands.density_set()["rules"] if r["id"] in DENSITY_SQL]
    rows = rule_sets.evaluate(docs(spark, sf_dir), rule_sets.resolve([{"name": "density", "rules": held}]))
    return rows.where("fires").select("doc_id", "rule", million(F.col("value")).alias("value_millionths"))
