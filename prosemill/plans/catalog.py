"""Queries over the provided tables, with the DuckDB SQL that checks them.

The documents are invented prose in which stock phrases do not occur, so phrase
rules are counted per document or rule with their zeros; exact spans are held by
"""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import COMMON_OPENERS, ENGLISH, FUNCTION_WORDS, RATE_WORD, SPACE, corpus_tokens, each, first_words, matches
from ..operators import analyze, corpus, detect, evaluate, library
from ..operators import rules as rule_sets
from ..operators.verdict import Notable, crossed, doc_stats, gates, judge, value_of
from ..sources.files import saved, spread
from ..sources.markup import html_text
from . import rulebook

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir, *more):
    """The columns asked for, spread before the text is taken apart; the projection stays above the exchange."""
    raw = read(spark, sf_dir, "documents").select("doc_id", "text", *more)
    return spread(raw).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def million(x):
    """A whole number of millionths, which both engines round alike."""
    return F.floor(x * 1e6 + 0.5).cast("long")


FW, EN, OPEN = (",".join(f"'{w}'" for w in words) for words in (FUNCTION_WORDS, ENGLISH, COMMON_OPENERS))
D = "d as (select doc_id, coalesce(text, '') as text, lang, source from documents)"
STATS = f"""{D}, st as (select doc_id, text, lang, source, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) ws_words, len(regexp_extract_all(text, '{RATE_WORD.replace("'", "''")}')) rate_words,
 len(regexp_extract_all(text, '[.!?](?:[ \\t\\n\\x0B\\f\\r]|$)')) gate_sentences,
 len(list_filter(list_transform(regexp_extract_all(text, '{RATE_WORD.replace("'", "''")}'), lambda x: lower(x)), lambda x: x in ({FW}))) fn_words from d)"""
BAG_SQL = "tok as (select doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) word from d), bag as (select doc_id, lang, word, count(*) tf from tok group by all)"


def bags(spark, sf_dir, *more):
    t = docs(spark, sf_dir, "lang", *more).withColumn("tokens", matches(F.lower("text"), "[a-z]{3,}"))
    return corpus.bag(t, "doc_id", "lang")


def rows_and_words(spark, sf_dir):
    """Rows with a bag each and their vocabulary, both as tables: texts are taken apart once, and the words' size is known before they are joined."""
    t = saved(docs(spark, sf_dir).select("doc_id", corpus.word_counts(matches(F.lower("text"), "[a-z]{3,}")).alias("bag")), "bags")
    return t, saved(corpus.row_vocabulary(t, 20).select("word"), "words")


def _bags_and_words(spark, sf_dir):
    t, words = rows_and_words(spark, sf_dir)
    return t.select("doc_id", F.inline("bag")), words


# ------------------------------------------------------------------ text


@query("doc_stats", f"with {STATS} select doc_id, cast(ws_words as bigint) ws_words, cast(rate_words as bigint) rate_words, cast(gate_sentences as bigint) gate_sentences, cast(fn_words as bigint) fn_words from st")
def q_doc_stats(spark, sf_dir):
    """V6 V7: per-document statistics computed once for all rules."""
    return doc_stats(docs(spark, sf_dir)).select("doc_id", "ws_words", "rate_words", "gate_sentences", "fn_words")


COMMAS = Notable({">=": 60.0}, per=1000)


@query("comma_rate", f"""with {STATS}, v as (select doc_id, cast(len(regexp_extract_all(text, ',')) as bigint) n, rate_words, gate_sentences, fn_words from st),
r as (select *, case when rate_words > 0 then n / rate_words * 1000 else 0 end as val from v)
select doc_id, n, cast(rate_words as bigint) rate_words, cast(floor(val * 1e6 + 0.5) as bigint) value_millionths,
 (rate_words >= 250 and gate_sentences >= 5 and (case when rate_words > 0 then fn_words / rate_words else 0 end) >= 0.12 and val >= 60) fires from r""")
def q_comma_rate(spark, sf_dir):
    """M1 V3 V6: commas per 1000 words, gated and judged."""
    rows = doc_stats(docs(spark, sf_dir)).withColumn("n", F.regexp_count("text", F.lit(",")).cast("long"))
    return judge(rows, F.col("n"), COMMAS).select("doc_id", "n", "rate_words", million(F.col("value")).alias("value_millionths"), "fires")


@query("band_verdict", f"""with {STATS}, r as (select doc_id, rate_words, gate_sentences, fn_words, case when rate_words > 0 then rate_words / greatest(gate_sentences, 1) else 0 end val from st)
select doc_id, cast(floor(val * 1e6 + 0.5) as bigint) value_millionths, case when val > 20 then '>' when val < 8 then '<' end bound from r""")
def q_band_verdict(spark, sf_dir):
    """V1 V5: words per sentence outside a band, with the bound crossed."""
    rows = doc_stats(docs(spark, sf_dir))
    v = F.when(F.col("rate_words") > 0, F.col("rate_words") / F.greatest("gate_sentences", F.lit(1))).otherwise(0.0)
    rule = Notable({">": 20.0, "<": 8.0}, metric=True)
    return rows.select("doc_id", million(value_of(v, rule)).alias("value_millionths"), crossed(v, rule).alias("bound"))


@query("tune_override", f"""with {STATS}, t(threshold) as (values (20.0), (40.0), (60.0), (80.0)), r as (select case when rate_words > 0 then len(regexp_extract_all(text, ',')) / rate_words * 1000 else 0 end val from st)
select threshold, count(*) filter (val >= threshold) fires from r, t group by 1""")
def q_tune_override(spark, sf_dir):
    """V9: one rule under several thresholds, in one pass over the documents."""
    rows = doc_stats(docs(spark, sf_dir)).select(value_of(F.regexp_count("text", F.lit(",")), COMMAS).alias("val"))
    sums = rows.agg(*(F.sum((F.col("val") >= t).cast("long")).alias(f"t{k}") for k, t in enumerate((20.0, 40.0, 60.0, 80.0))))
    return sums.select(F.expr("stack(4, cast(20.0 as double), t0, cast(40.0 as double), t1, cast(60.0 as double), t2, cast(80.0 as double), t3) as (threshold, fires)")).withColumn("threshold", F.col("threshold").cast("decimal(3,1)"))


@query("rhythm_cv", f"""with {D}, p as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(regexp_extract_all(s, '{RATE_WORD.replace("'", "''")}'))), lambda n: n > 0) l from d),
s as (select doc_id, len(l) n, list_sum(l) t, list_sum(list_transform(l, lambda x: x * x)) q from p)
select doc_id, cast(n as int) sentences, case when n > 0 and t / n between 1 and 200 then cast(floor(sqrt(cast(n * q - t * t as double)) / t * 1e6 + 0.5) as bigint) end cv_millionths from s""")
def q_rhythm(spark, sf_dir):
    """M8 V5: coefficient of variation of sentence lengths; null where not judgeable."""
    value, n = detect.rhythm(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", n.cast("int").alias("sentences"), million(value).alias("cv_millionths"))


@query("truncate_words", f"with {D} select doc_id, regexp_extract(text, '^(?:[ \\t\\n\\x0B\\f\\r]*[^ \\t\\n\\x0B\\f\\r]+){{0,50}}') head from d")
def q_truncate(spark, sf_dir):
    """The first fifty words."""
    return docs(spark, sf_dir).select("doc_id", first_words(F.col("text"), 50).alias("head"))


# Own phrase patterns without look-around, so that both engines run them as they stand.
PHRASES = {"testament": r"\btestament to\b", "in_order_to": r"\bin order to\b", "not_only": r"\bnot (?:only|just)\b", "is_the": r"\bis the\b", "of_the": r"\bof the\b", "exclamation": "!", "table_mark": r"\|", "percent_run": "%%%"}


def lowered(rows):
    """rows with the lower-cased text, made once for all phrases."""
    return rows.withColumn("lowered", F.lower("text"))


def phrase_count(pattern):
    return detect.counted(F.col("text"), F.col("lowered"), pattern)


@query("regex_rule_counts", f"with {D} " + " union all ".join(f"select '{k}' as rule, cast(sum(len(regexp_extract_all(text, '(?i){p}'))) as bigint) n, count(*) filter (len(regexp_extract_all(text, '(?i){p}')) > 0) docs_hit from d" for k, p in PHRASES.items()))
def q_regex_rules(spark, sf_dir):
    """A1 M1 V2: every phrase rule over every document in one scan, zeros included."""
    counted = lowered(docs(spark, sf_dir)).select(*(phrase_count(p).alias(k) for k, p in PHRASES.items()))
    one = counted.agg(*(F.sum(k).cast("long").alias(f"n_{k}") for k in PHRASES), *(F.sum((F.col(k) > 0).cast("long")).alias(f"d_{k}") for k in PHRASES))
    return one.select(F.expr("stack(%d, %s) as (rule, n, docs_hit)" % (len(PHRASES), ", ".join(f"'{k}', n_{k}, d_{k}" for k in PHRASES))))


@query("occurrence_offsets", r"""with d as (select doc_id, coalesce(text, '') as text from documents), p as (select doc_id, regexp_extract_all(text, '[A-Z]+!!') m, string_split(regexp_replace(text, '[A-Z]+!!', chr(1), 'g'), chr(1)) g from d),
i as (select doc_id, m, g, unnest(range(1, len(m) + 1)) k from p where len(m) > 0)
select doc_id, cast(k as int) k, cast(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) as int) as "start", m[k] as "value" from i""")
def q_offsets(spark, sf_dir):
    """M1: offsets of every occurrence."""
    found = detect.regex(F.col("text"), "[A-Z]+!!", ignore_case=False)
    return docs(spark, sf_dir).select("doc_id", F.posexplode(found).alias("k", "o")).select("doc_id", (F.col("k") + 1).alias("k"), F.col("o.start").alias("start"), F.col("o.value").alias("value"))


@query("question_chain", f"with {D} select doc_id, len(regexp_extract_all(text, '[^.!?\\n]+\\?(?:[ \\t\\n\\x0B\\f\\r]+[^.!?\\n]+\\?)+')) n from d")
def q_question_chain(spark, sf_dir):
    """M5: stacked questions by document."""
    return docs(spark, sf_dir).select("doc_id", F.size(detect.question_chain(F.col("text"))).cast("long").alias("n"))


@query("chain_no", f"with {D} select doc_id, len(regexp_extract_all(text, '(?i)\\bno [^,.;:!?\\n]+(?:, no [^,.;:!?\\n]+)+')) n from d")
def q_chain(spark, sf_dir):
    """M3: chains of "no x, no y" by document."""
    return docs(spark, sf_dir).select("doc_id", F.size(detect.chain(F.col("text"), r"\bno [^,.;:!?\n]+(?:, no [^,.;:!?\n]+)+", r"^no\b")).cast("long").alias("n"))


SENT_SQL = """s0 as (select doc_id, regexp_extract_all(text, '{p}') m, string_split(regexp_replace(text, '{p}', chr(1), 'g'), chr(1)) g from d),
s1 as (select doc_id, unnest(range(1, len(m) + 1)) k, unnest(m) as "value", unnest(g[1:len(m)]) gap from s0),
s as (select doc_id, k, "value", cast(sum(length(gap) + length("value")) over (partition by doc_id order by k) as bigint) stop, cast(sum(length(gap) + length("value")) over (partition by doc_id order by k) - length("value") as bigint) as "start" from s1)"""


@query("anaphora_runs", f"""with {D}, {SENT_SQL.format(p="[^.!?\\n]+[.!?]")},
h as (select doc_id, k, stop, regexp_extract("value", '[A-Za-z''’-]+') w, "start", "value" from s), h2 as (select doc_id, k, stop, lower(w) head, "start" + strpos("value", w) - 1 as "start" from h where w <> ''),
l as (select *, lag(head) over (partition by doc_id order by k) ph, lag(stop) over (partition by doc_id order by k) ps from h2),
c as (select *, sum(case when head = ph and "start" - ps < 4 then 0 else 1 end) over (partition by doc_id order by k) island from l)
select doc_id, cast(min("start") as int) as "start", cast(max(stop) as int) stop, count(*) n, min(head) head from c group by doc_id, island having count(*) >= 3 and min(head) not in ({OPEN})""")
def q_anaphora(spark, sf_dir):
    """M6: runs of sentences with one opening word (gaps and islands)."""
    return detect.anaphora(docs(spark, sf_dir))


@query("echo_runs", f"""with {D}, {SENT_SQL.format(p="[^.!?\\n]+[.!?]?")},
w as (select *, regexp_extract_all(lower("value"), '[a-z0-9''’-]+') ws from s where len(regexp_extract_all("value", '[^ \\t\\n\\x0B\\f\\r]+')) >= 4),
g as (select doc_id, k, "start", stop, "value", case when len(ws) >= 4 then list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) else [] end grams from w),
l as (select *, lag(grams) over (partition by doc_id order by k) pg, lag(stop) over (partition by doc_id order by k) ps from g),
c as (select *, sum(case when len(list_intersect(grams, pg)) > 0 and "start" - ps <= 3 then 0 else 1 end) over (partition by doc_id order by k) island from l)
select doc_id, cast(min("start") as int) as "start", cast(max(stop) - (length(arg_max("value", k)) - length(rtrim(arg_max("value", k), chr(32) || chr(9)))) as int) stop, count(*) n from c group by doc_id, island having count(*) >= 2""")
def q_echo(spark, sf_dir):
    """M4: runs of neighbouring sentences that share four words in a row."""
    return detect.echo(docs(spark, sf_dir)).select("doc_id", "start", "stop", "n")


# Own sentences on one skeleton, behind every fifth document: the prose itself repeats none.
FRAMED = "text || case when doc_id % 5 = 0 then chr(10) || 'The cat of Ann is in the house by the sea. A gull cries. The dog of Bob is in the barn by the mill. The hen of Cid is in the shed by the road. The ox of Dan is in an open field by a river.' else '' end"
MARK = detect.CODE_MARK.replace("'", "''")


@query("frame_runs", f"""with {D.replace("coalesce(text, '') as text", "coalesce(text, '') as t_")}, f as (select doc_id, {FRAMED.replace("text ||", "t_ ||", 1)} as text from d), {SENT_SQL.format(p="[^.!?\\n]*[.!?]+").replace("from d)", "from f)")},
v as (select doc_id, k, stop, regexp_replace("value", '^\\s+', '') x from s), p as (select *, len(regexp_extract_all(x, '[A-Za-z]')) n, list_transform(regexp_extract_all(x, '[A-Za-z][A-Za-z''’-]*|[,;:()"]')[1:8], lambda t: case when t in (',', ';', ':', '(', ')', '"') then t when lower(t) = 'an' then 'a' when lower(t) in ({FW}) then lower(t) else '_' end) g from v where x <> ''),
q as (select doc_id, k, stop, stop - length(x) as "start", case when len(g) >= 8 and len(list_filter(g, lambda t: t <> '_')) >= 2 then array_to_string(g, ' ') end sig from p where n >= 13 and not regexp_matches(x, '{MARK}') and len(regexp_extract_all(x, '[A-Za-z\\s]')) / length(x) >= 0.62),
l as (select *, lag(sig) over (partition by doc_id order by k) before from q), i as (select *, sum(case when sig = before then 0 else 1 end) over (partition by doc_id order by k) island from l)
select doc_id, cast(min("start") as int) as "start", cast(max(stop) as int) stop, count(*) n, min(sig) sig from i group by doc_id, island having count(*) >= 3 and min(sig) is not null""")
def q_frames(spark, sf_dir):
    """M7: runs of sentences on one skeleton."""
    return detect.frames(docs(spark, sf_dir).withColumn("text", F.expr(FRAMED)))


# ------------------------------------------------------------------ analysis


@query("findings_overlap_collapse", r"""with d as (select doc_id, coalesce(text, '') as text from documents), r(rule, rule_ord, p) as (values ('comma_and', 1, ', [a-z]+ [a-z]+'), ('the_word', 2, 'the [a-z]+'), ('long_word', 3, '[a-z]{10,}')),
m as (select doc_id, rule, rule_ord, regexp_extract_all(text, p) m, string_split(regexp_replace(text, p, chr(1), 'g'), chr(1)) g from d, r),
e as (select doc_id, rule, rule_ord, unnest(range(1, len(m) + 1)) k, unnest(m) v, unnest(g[1:len(m)]) gap from m),
o as (select doc_id, rule, rule_ord, cast(sum(length(gap) + length(v)) over (partition by doc_id, rule order by k) as int) stop, length(v) n from e),
a as (select doc_id, list(struct_pack(b := stop - n, e := stop, o := rule_ord, r := rule) order by stop - n, -stop, rule_ord) l from o group by doc_id),
f as (select doc_id, list_reduce(l, lambda acc, x: case when x.b < acc.last then acc else struct_pack(last := x.e, n := acc.n + 1) end, struct_pack(last := -1, n := 0)) z from (select doc_id, list_transform(l, lambda x: struct_pack(b := x.b, e := x.e, last := 0, n := 0)) l from a))
select doc_id, cast(z.n as bigint) kept from f""")
def q_collapse(spark, sf_dir):
    """A3: overlapping findings of three rules collapse, by a fold over each document."""
    t = docs(spark, sf_dir)
    rules = (("comma_and", ", [a-z]+ [a-z]+"), ("the_word", "the [a-z]+"), ("long_word", "[a-z]{10,}"))
    every = F.concat(*(F.transform(detect.regex(F.col("text"), p, False), _tagged(name, k)) for k, (name, p) in enumerate(rules, 1)))
    found = t.select("doc_id", F.explode(every).alias("o")).select("doc_id", "o.*")
    return analyze.collapse(found).groupBy("doc_id").agg(F.count("*").alias("kept"))


def _tagged(name, k):
    return lambda o: F.struct(F.lit(name).alias("rule"), F.lit(k).alias("rule_ord"), o["start"].alias("start"), o["stop"].alias("stop"), F.lit(False).alias("doc_level"))


@query("report_totals", f"with {STATS} select cast(sum(len(regexp_extract_all(text, '!'))) as bigint) total, cast(sum(ws_words) as bigint) words, cast(floor(sum(len(regexp_extract_all(text, '!'))) / sum(ws_words) * 1e6 + 0.5) as bigint) per1000_thousandths, sum(len(regexp_extract_all(text, '!'))) / sum(ws_words) * 1000 > 2 over_budget from st")
def q_totals(spark, sf_dir):
    """A5 K6: totals and the budget gate."""
    s = doc_stats(docs(spark, sf_dir)).agg(F.sum(F.regexp_count("text", F.lit("!"))).cast("long").alias("total"), F.sum("ws_words").alias("words"))
    return s.select("total", "words", million(F.col("total") / F.col("words")).alias("per1000_thousandths"), (F.col("total") / F.col("words") * 1000 > 2).alias("over_budget"))


# ------------------------------------------------------------------ corpus


@query("bag_of_words", f"with {D}, {BAG_SQL} select doc_id, word, tf from bag")
def q_bag(spark, sf_dir):
    """Term frequencies by document."""
    return bags(spark, sf_dir).select("doc_id", "word", "tf")


@query("df_vocab", f"with {D}, {BAG_SQL} select word, count(*) df from bag group by word having count(*) >= 20")
def q_df(spark, sf_dir):
    """Words in at least twenty documents."""
    return corpus.vocabulary(bags(spark, sf_dir), 20)


@query("known_documents", f"with {D}, {BAG_SQL}, v as (select word from bag group by word having count(*) >= 20) select doc_id, count(*) known, cast(sum(tf) as bigint) tokens from bag join v using (word) group by doc_id having count(*) >= 5")
def q_known(spark, sf_dir):
    """Documents with at least five words of the vocabulary."""
    return corpus.known_counts(*_bags_and_words(spark, sf_dir))


LIFT_SQL = f"""with {D}, {BAG_SQL}, sz as (select lang, count(distinct doc_id) sz from bag group by lang), tot as (select sum(sz) n from sz), ins as (select lang, word, count(*) inside from bag group by all), ev as (select word, sum(inside) every from ins group by word),
r as (select lang, word, inside, cast(every as bigint) every, (inside / sz) / ((every - inside + 25.0::double) / greatest(n - sz, 1)) lift from ins join ev using (word) join sz using (lang), tot),
k as (select *, row_number() over (partition by lang order by lift desc, word) as "rank" from r)"""


def lifted(spark, sf_dir):
    """Words by lift in each language; a language's size is counted without its words."""
    sizes = docs(spark, sf_dir, "lang").where(F.lower("text").rlike("[a-z]{3,}")).groupBy("lang").agg(F.count("*").alias("size"))
    return corpus.lift_rank(bags(spark, sf_dir), "lang", sizes=sizes)


@query("lift_rank", LIFT_SQL + ' select lang, word, inside, every, cast(floor(lift * 1e6 + 0.5) as bigint) lift_millionths, cast("rank" as int) as "rank" from k where "rank" <= 50')
def q_lift(spark, sf_dir):
    """The fifty words of highest lift in each language (the limit is the report)."""
    return lifted(spark, sf_dir).where("rank <= 50").withColumn("lift_millionths", million(F.col("lift"))).drop("lift")


@query("vocab_verdict", LIFT_SQL + f""", v as (select distinct word from k where "rank" <= 100 and lang = 'en'), h as (select doc_id, count(*) n from bag join v using (word) group by doc_id), {STATS.split(",", 1)[1].split("st as", 1)[0] and "st as" + STATS.split("st as", 1)[1]}
select st.doc_id, coalesce(n, 0) n_distinct, cast(floor(case when rate_words > 0 then coalesce(n, 0) / pow(rate_words, 0.7) else 0 end * 1e6 + 0.5) as bigint) value_millionths from st left join h using (doc_id)""")
def q_vocab(spark, sf_dir):
    """M2 V4: distinct words of a derived list per word count to the power 0.7, by looking tokens up."""
    listed = [r.word for r in lifted(spark, sf_dir).where("rank <= 100 and lang = 'en'").select("word").collect()]  # a word list is part of a rule
    found = F.filter(matches(F.lower("text"), "[a-z]{3,}"), lambda w: w.isin(listed))
    rows = doc_stats(docs(spark, sf_dir)).withColumn("n", F.size(F.array_distinct(found)).cast("long"))
    return rows.select("doc_id", F.col("n").alias("n_distinct"), million(value_of(F.col("n"), Notable({">=": 0.095}, power=0.7))).alias("value_millionths"))


@query("corpus_tokens", f"""with {D}, t as (select doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(lower(text), 'https?://[^ \\t\\n\\x0B\\f\\r<>"''`)\\]}}]+', ' ', 'g'), '<[a-z/!][^<>]*>', ' ', 'g'), '[a-z0-9_/-]*[a-z][a-z0-9_/-]*'), lambda w: regexp_replace(regexp_replace(regexp_replace(w, '^[_/]+', ''), '[_/]+$', ''), '-+$', '')), lambda w: len(regexp_extract_all(w, '[a-z]')) >= 3) tk from d)
select doc_id, len(tk) tokens, len(list_filter(tk, lambda w: w in ({EN}))) english, len(tk) >= 25 and len(list_filter(tk, lambda w: w in ({EN}))) >= 0.12 * len(tk) usable from t""")
def q_corpus_tokens(spark, sf_dir):
    """Pipeline tokens and the usable-text filter."""
    t = docs(spark, sf_dir).withColumn("tk", corpus_tokens(F.col("text"))).select("doc_id", F.size("tk").cast("long").alias("tokens"), F.size(F.filter("tk", lambda w: w.isin(ENGLISH))).cast("long").alias("english"))
    return t.withColumn("usable", (F.col("tokens") >= 25) & (F.col("english") >= 0.12 * F.col("tokens")))


@query("weekly_series", "select cast(date_trunc('week', ts) as date) as \"week\", event_type, count(*) n, count(distinct user_id) users from events group by all")
def q_weekly(spark, sf_dir):
    """Weekly counts by product."""
    return read(spark, sf_dir, "events").groupBy(F.date_trunc("week", "ts").cast("date").alias("week"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("day_summary", "select cast(ts as date) as day, value > 50 signed, count(*) docs, count(distinct user_id) authors from events group by all")
def q_day(spark, sf_dir):
    """Documents and authors by day and side."""
    return read(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), (F.col("value") > 50).alias("signed")).agg(F.count("*").alias("docs"), F.countDistinct("user_id").alias("authors"))


@query("arrived_groups", """with r as (select event_type, cast(date_trunc('week', ts) as date) as wk, value > 50 s from events), w as (select wk, row_number() over (order by wk) i, count(*) over () j from (select distinct wk from r)), x as (select * from r join w using (wk)),
a as (select sum((i <= 4)::int) f, sum((i > j - 4)::int) l from x)
select event_type, count(*) size, cast(sum(s::int) as bigint) signed, cast(floor(sum((i <= 4)::int) / any_value(f) * 1e6 + 0.5) as bigint) start_millionths, cast(floor(sum((i > j - 4)::int) / any_value(l) * 1e6 + 0.5) as bigint) end_millionths, sum((i <= 4)::int) / any_value(f) < 0.02 and sum((i > j - 4)::int) / any_value(l) >= 0.2 arrived from x, a group by event_type""")
def q_arrived(spark, sf_dir):
    """Sizes, flagged share, first and last weeks' shares, arrival."""
    e = read(spark, sf_dir, "events").select("event_type", F.date_trunc("week", "ts").cast("date").alias("week"), (F.col("value") > 50).alias("s"))
    return corpus.group_series(e, "event_type", "week", "s").select("event_type", "size", "signed", million(F.col("start_share")).alias("start_millionths"), million(F.col("end_share")).alias("end_millionths"), "arrived")


@query("publish_runner_up", "with g as (select event_type, avg((value > 50)::int) stamped, count(*) n from events group by 1), r as (select *, row_number() over (order by stamped desc, event_type) k from g) select cast(k as int) place, event_type, n from r where k <= 2")
def q_publish(spark, sf_dir):
    """The group with the highest flagged share, and the runner-up."""
    g = read(spark, sf_dir, "events").groupBy("event_type").agg(F.avg((F.col("value") > 50).cast("int")).alias("stamped"), F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("stamped"), "event_type"))).where("place <= 2").select("place", "event_type", "n")


@query("backfill_days", "with c as (select cast(unnest(generate_series(timestamp '2023-12-20', timestamp '2024-02-10', interval 1 day)) as date) as day) select day from c where day not in (select cast(ts as date) from events) order by day limit 15")
def q_backfill(spark, sf_dir):
    """C11: the oldest fifteen days of the calendar without data."""
    return corpus.missing_days(read(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day")), "2023-12-20", "2024-02-10", 15)


@query("surrogate_ids", "with e as (select distinct cast(ts as date) as day, user_id from events) select day, user_id, cast(dense_rank() over (partition by day order by user_id) - 1 as int) author from e")
def q_surrogate(spark, sf_dir):
    """Surrogate author ids within each day."""
    e = read(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "user_id").distinct()
    return e.withColumn("author", F.dense_rank().over(Window.partitionBy("day").orderBy("user_id")) - 1)


@query("snapshot_churn", "with s as (select distinct cast(date_trunc('week', ts) as date) generated, user_id % 500 word from events), o as (select generated, lag(generated) over (order by generated) b from (select distinct generated from s)), n as (select s.generated, s.word, p.word pw from s join o using (generated) left join s p on p.generated = o.b and p.word = s.word where o.b is not null) select generated, count(*) words, count(*) filter (pw is null) fresh from n group by generated")
def q_churn(spark, sf_dir):
    """The churn that C24 and C25 judge: words of each snapshot that its predecessor lacks."""
    s = read(spark, sf_dir, "events").select(F.date_trunc("week", "ts").cast("date").alias("generated"), F.pmod("user_id", F.lit(500)).alias("word")).distinct()
    return corpus.churn(s).select("generated", "words", "fresh")


@query("history_trajectory", "with b as (select distinct cast(date_trunc('week', ts) as date) built from events), r as (select cast(date_trunc('week', ts) as date) built, event_type word, row_number() over (partition by cast(date_trunc('week', ts) as date) order by count(*) desc, event_type) as rk from events group by 1, 2), w as (select distinct word from r where rk <= 3) select built, word, cast(rk as int) as rk from b cross join w left join (select * from r where rk <= 3) using (built, word)")
def q_trajectory(spark, sf_dir):
    """Rank of each word in each build, null where absent."""
    e = read(spark, sf_dir, "events").groupBy(F.date_trunc("week", "ts").cast("date").alias("built"), F.col("event_type").alias("word")).agg(F.count("*").alias("n"))
    r = e.withColumn("rk", F.row_number().over(Window.partitionBy("built").orderBy(F.desc("n"), "word"))).where("rk <= 3").select("built", "word", "rk")
    grid = e.select("built").distinct().join(F.broadcast(r.select("word").distinct()))  # builds by listed words: both are short lists
    return grid.join(r, ["built", "word"], "left")


def saver(spark):
    return lambda df: saved(df, "kmeans")


@query("kmeans_assign")
def q_kmeans(spark, sf_dir):
    """C14: multinomial k-means over the vocabulary."""
    return corpus.kmeans_rows(*rows_and_words(spark, sf_dir), [10], iterations=25, save=saver(spark)).select("doc_id", F.col("k10").alias("cluster"))


# ------------------------------------------------------------------ evaluation


SIDE_SQL = "side as (select d.doc_id, d.text, d.source, case when quality = 1 then 'ai' else 'human' end side from d join labels l using (doc_id))"


def sides(spark, sf_dir):
    lab = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "ai").otherwise("human").alias("side"))
    return docs(spark, sf_dir, "source", "lang").join(lab, "doc_id")


@query("rule_rates_by_side", f"with {D}, {SIDE_SQL} " + " union all ".join(f"select '{k}' as rule, side, cast(sum(len(regexp_extract_all(text, '(?i){p}'))) as bigint) spans, count(*) filter (len(regexp_extract_all(text, '(?i){p}')) > 0) docs_hit from side group by side" for k, p in PHRASES.items()))
def q_rates(spark, sf_dir):
    """Spans and documents hit by rule and side, one scan for all rules."""
    t = lowered(sides(spark, sf_dir)).select("side", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), phrase_count(p).cast("long").alias("n")) for k, p in PHRASES.items()))).alias("r"))
    return t.groupBy("r.rule", "side").agg(F.sum("r.n").alias("spans"), F.sum((F.col("r.n") > 0).cast("long")).alias("docs_hit"))


@query("silent_rules", f"with {D}, r(rule) as (values {', '.join(f'({k!r})' for k in PHRASES)}), h as (" + " union all ".join(f"select '{k}' as rule from d where len(regexp_extract_all(text, '(?i){p}')) > 0" for k, p in PHRASES.items()) + ") select rule from r where rule not in (select rule from h)")
def q_silent(spark, sf_dir):
    """Rules that never fire (anti join)."""
    rules = spark.createDataFrame([(k,) for k in PHRASES], "rule string")
    return rules.join(q_regex_rules(spark, sf_dir).where("docs_hit > 0"), "rule", "left_anti")


@query("register_scorecard", f"with {D}, x as (select d.lang, case when quality = 1 then 'ai' else 'human' end side, d.text from d join labels l using (doc_id)) select lang, side, count(*) n, cast(sum(len(regexp_extract_all(text, '!'))) as bigint) marks from x group by grouping sets ((lang, side), (side), ())")
def q_scorecard(spark, sf_dir):
    """Overall, by side and by register in one pass (grouping sets)."""
    t = sides(spark, sf_dir).withColumn("m", F.regexp_count("text", F.lit("!")).cast("long"))
    return t.groupingSets([["lang", "side"], ["side"], []], "lang", "side").agg(F.count("*").alias("n"), F.sum("m").alias("marks"))


SCORE_SQL = f"{SIDE_SQL}, sc as (select doc_id, side, len(regexp_extract_all(text, '{RATE_WORD.replace("'", "''")}')) score from side)"


@query("threshold_at_budget", f"with {D}, {SCORE_SQL}, h as (select score, row_number() over (order by score desc) k from sc where side = 'human'), t as (select max(score) filter (k = 4) + 1e-9 th from h) select count(*) filter (side = 'ai' and score >= th) caught, count(*) filter (side = 'human' and score >= th) false_alarms from sc, t")
def q_budget(spark, sf_dir):
    """Threshold just above the fourth highest human score, and what it catches."""
    t = sides(spark, sf_dir).select("doc_id", "side", F.regexp_count("text", F.lit(RATE_WORD)).cast("double").alias("score"))
    return evaluate.threshold_at_budget(t, 3).select("caught", "false_alarms")


@query("kfold_threshold", f"with {D}, {SCORE_SQL}, f as (select unnest(range(0, 4)) fold), h as (select fold, score, row_number() over (partition by fold order by score desc) k from sc, f where side = 'human' and doc_id % 4 <> fold), t as (select fold, max(score) filter (k = 2) th from h group by fold) select fold, count(*) filter (side = 'ai' and score > th) caught, count(*) filter (side = 'human' and score > th) false_alarms from sc join t on sc.doc_id % 4 = t.fold group by fold")
def q_kfold(spark, sf_dir):
    """Thresholds chosen on three folds, scored on the fourth."""
    t = evaluate.folds(sides(spark, sf_dir).select("doc_id", "side", F.regexp_count("text", F.lit(RATE_WORD)).alias("score")))
    train = t.where("side = 'human'").select(F.explode(F.expr("filter(array(0, 1, 2, 3), x -> x <> fold)")).alias("fold"), "score")
    th = train.withColumn("k", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("score")))).where("k = 2").select("fold", F.col("score").alias("th"))
    return t.join(F.broadcast(th), "fold").groupBy(F.col("fold").cast("long").alias("fold")).agg(F.sum(((F.col("side") == "ai") & (F.col("score") > F.col("th"))).cast("long")).alias("caught"), F.sum(((F.col("side") == "human") & (F.col("score") > F.col("th"))).cast("long")).alias("false_alarms"))


@query("exponent_sweep", f"with {D}, {SCORE_SQL}, c as (select sc.doc_id, sc.side, sc.score, len(regexp_extract_all(side.text, ',')) n from sc join side using (doc_id)), b(beta) as (values (0.4), (0.7), (1.0)), v as (select beta, c.side, case when score > 0 then n / pow(score, beta::double) else 0 end v from c, b) select beta, side, count(*) n, cast(floor(avg(v) * 1e5 + 0.5) as bigint) mean_1e5 from v group by all")
def q_exponent(spark, sf_dir):
    """Mean normalised value by exponent and side."""
    t = sides(spark, sf_dir).select("side", F.regexp_count("text", F.lit(RATE_WORD)).alias("w"), F.regexp_count("text", F.lit(",")).alias("c"))
    t = t.select("side", "w", "c", F.explode(F.expr("array(0.4, 0.7, 1.0)")).alias("beta"))
    v = F.when(F.col("w") > 0, F.col("c") / F.pow(F.col("w").cast("double"), F.col("beta").cast("double"))).otherwise(0.0)
    return t.groupBy("beta", "side").agg(F.count("*").alias("n"), F.floor(F.avg(v) * 1e5 + 0.5).cast("long").alias("mean_1e5"))


@query("word_lift_classes", f"with {D}, {SIDE_SQL}, t as (select distinct doc_id, side, unnest(regexp_extract_all(lower(text), '[a-z][a-z''’-]*')) word from side), c as (select word, count(*) filter (side = 'ai') ai, count(*) filter (side = 'human') human from t group by word) select word, ai, human, case when (ai + 1) / (human + 1) > 1.2 then 'ai' when (ai + 1) / (human + 1) < 0.83 then 'human' else 'even' end as class from c")
def q_word_classes(spark, sf_dir):
    """Words by side, with the class of their lift."""
    t = sides(spark, sf_dir).select("doc_id", "side", F.explode(F.array_distinct(matches(F.lower("text"), "[a-z][a-z'’-]*"))).alias("word"))
    return evaluate.word_classes(t).drop("lift")


# Own phrase rules, some of which fire wherever another does.
NESTED = {"shout": "[A-Z]+!!", "exclamation": "!", "marks": "!!", "of_the": r"\\bof the\\b", "the": r"\\bthe\\b", "percent_run": "%%%", "percent": "%", "table_mark": r"\\|"}


@query("redundancy_division", f"with {D}, f as (" + " union all ".join(f"select doc_id, '{k}' as rule from d where regexp_matches(text, '{p}')" for k, p in NESTED.items()) + "), z as (select rule, count(*) n from f group by rule), c as (select a.rule rule_a, b.rule rule_b, count(*) k from f a join f b on a.doc_id = b.doc_id and a.rule <> b.rule group by all) select rule_a, rule_b, n from c join z on z.rule = rule_a where k = n")
def q_redundant(spark, sf_dir):
    """rules that fire on every example of another (division); the examples of a rule are the documents it fires on."""
    fired = F.filter(F.array(*(F.when(F.col("text").rlike(p), F.lit(k)) for k, p in NESTED.items())), lambda x: x.isNotNull())
    t = docs(spark, sf_dir).select("doc_id", fired.alias("r"))
    hits = t.select(F.explode(each("r")).alias("example_rule"), F.col("doc_id").alias("example"), "r").select("example_rule", "example", F.explode(each("r")).alias("rule"))
    return evaluate.redundant(hits)


@query("corpus_integrity", "select source, count(*) n, min(substr(sha256(coalesce(text, '')), 1, 16)) first_hash from documents group by source")
def q_integrity(spark, sf_dir):
    """Content hashes by source."""
    return docs(spark, sf_dir, "source").groupBy("source").agg(F.count("*").alias("n"), F.min(F.substring(F.sha2("text", 256), 1, 16)).alias("first_hash"))


# ------------------------------------------------------------------ extraction


@query("html_extract_full")
def q_html(spark, sf_dir):
    """Prose of every page, with offsets kept by the extractor."""
    return spread(read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", html_text(F.col("html")).alias("text"))


# ------------------------------------------------------------------ the rule sets that come with the engine


@query("rule_list")
def q_rule_list(spark, sf_dir):
    """The bundled rules with their state."""
    return library.rule_rows(spark, rulebook.SETS)


RULES = rule_sets.resolve(rulebook.SETS, everything=True)


def re2(rule: dict) -> str:
    """A rule's pattern as DuckDB takes it."""
    space = SPACE[1:-1].replace("\\s", r"\t-\r ")
    parts = re.findall(r"\\.|\[\^?|\]|.", re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), rule["match"]["pattern"]), re.S)
    depth, out = 0, []
    for p in parts:
        depth += (p in ("[", "[^")) - (p == "]")
        out.append((space if depth else f"[{space}]") if p == "\\s" else (f"^{space}" if depth else f"[^{space}]") if p == "\\S" else r"\z" if p == "$" and not depth else p)
    return ("(?i)" if "i" in rule["match"].get("flags", "") else "") + "".join(out).replace("'", "''")


def plain(rule: dict) -> bool:
    m = rule["match"]
    return m["kind"] == "regex" and not m.get("distinct") and not re.search(r"\(\?[=!<]|\\[1-9]", m["pattern"])


PLAIN = [r for r in RULES if plain(r)]


@query("rule_match_counts", f"with {D}, c as (" + " union all ".join(f"select doc_id, '{r['id']}' as rule, cast(len(regexp_extract_all(text, '{re2(r)}')) as bigint) n from d" for r in PLAIN) + ") select doc_id, rule, n from c where n > 0")
def q_rule_counts(spark, sf_dir):
    """M1 A1: matches of the bundled rules without look-around, for every document with any."""
    rows = rule_sets.counts(docs(spark, sf_dir), PLAIN).select("doc_id", F.posexplode(each("n")).alias("k", "n")).where("n > 0")
    return rows.select("doc_id", F.get(F.array(*(F.lit(r["id"]) for r in PLAIN)), F.col("k")).alias("rule"), F.col("n").cast("long").alias("n"))


@query("rule_findings")
def q_rule_findings(spark, sf_dir):
    """A1 V1-V9: every bundled rule judged on every document; the rows are the verdicts that fire."""
    return rule_sets.evaluate(docs(spark, sf_dir), RULES).where("fires").select("doc_id", "rule", million(F.col("value")).alias("value_millionths"), "bound")


def _all() -> None:
    """Register the queries of the other modules."""
    from . import corpus_queries, evaluation_queries, findings_queries, stream_queries  # noqa: F401


def queries() -> dict:
    _all()
    return dict(Q)


def oracle_sql() -> dict:
    _all()
    return dict(SQL)
