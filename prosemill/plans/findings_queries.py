"""Queries of assembled findings: places, contexts, findings of span and document rules, navigation, the JSON report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import RATE_WORD, let
from ..operators import analyze, corpus, detect, evaluate, findings, publish, rules, selftest
from ..operators.verdict import doc_stats
from ..sources.files import findings_annotations, findings_tsv, saved, spread
from ..sources.markup import extracted
from . import rulebook
from .catalog import BAG_SQL, STATS, D, bags, docs, million, query, read

# Own rules without look-around, so that both engines run them as they stand: four of spans and one of the document.
OWN = {
    "name": "own",
    "rules": [
        {"id": "shout", "match": {"kind": "regex", "pattern": "[A-Z]+!!"}, "notable": {">": 0}, "suggest": "Say it once."},
        {"id": "the-word", "match": {"kind": "regex", "pattern": "the [a-z]+"}, "notable": {">": 0}},
        {"id": "percent-run", "match": {"kind": "regex", "pattern": "%%%"}, "notable": {">": 0}},
        {"id": "long-word", "match": {"kind": "regex", "pattern": "[a-z]{12,}"}, "notable": {">": 0}},
        {"id": "commas", "match": {"kind": "regex", "pattern": ","}, "notable": {">=": 60, "per": 1000}},
    ],
}
RULES = rules.resolve([OWN])
RATE = RATE_WORD.replace("'", "''")
#: CTE o(doc_id, "start", stop) of a pattern's matches m in the documents d.
PLACES = """p_ as (select doc_id, text, regexp_extract_all(text, '{p}') m, string_split(regexp_replace(text, '{p}', chr(1), 'g'), chr(1)) g from d),
e_ as (select doc_id, text, unnest(range(1, len(m) + 1)) k, unnest(m) v, unnest(g[1:len(m)]) gap from p_ where len(m) > 0),
o as (select doc_id, text, cast(sum(length(gap) + length(v)) over (partition by doc_id order by k) as bigint) stop, length(v) n from e_)"""


def line_sql(off: str) -> str:
    return f"cast(length(substr(text, 1, {off})) - length(replace(substr(text, 1, {off}), chr(10), '')) + 1 as int)"


def col_sql(off: str) -> str:
    return f"cast(length(regexp_extract(substr(text, 1, {off}), '[^\\n]*$')) + 1 as int)"


def sentence_sql(a: str, b: str) -> str:
    return f"regexp_replace(regexp_extract(substr(text, 1, {a}), '[^\\n.!?…]*$'), '^\\s+', '') || substr(text, {a} + 1, {b} - {a}) || regexp_extract(substr(text, {b} + 1), '^[^\\n.!?…]*(?:[.!?…][\"''”’)\\]]*)?')"


def _each(rows, pattern, told):
    """doc_id and the fields of told(table of places, length of the text, match) for every match, made inside the row of its text."""
    found = rows.withColumn("o", detect.regex(F.col("text"), pattern, False))
    made = F.when(F.size("o") > 0, let(F.struct(analyze.place_table(F.col("text")).alias("t"), F.length("text").alias("n")), lambda x: F.transform("o", lambda o: told(x["t"], x["n"], o))))
    return found.select("doc_id", F.inline(made))


@query("line_positions", f"with {D}, {PLACES.format(p='[|]')} select doc_id, cast(stop - n as int) as off, {line_sql('stop - n')} line, {col_sql('stop - n')} col from o")
def q_lines(spark, sf_dir):
    """Line and column of every table mark."""
    told = lambda table, _, o: let(analyze.place(table, o["start"]), lambda p: F.struct(o["start"].alias("off"), p["line"].alias("line"), p["col"].alias("col")))
    return _each(docs(spark, sf_dir), r"\|", told)


@query("sentence_context", f"""with {D}, {PLACES.format(p='[A-Z]+!!')}, w as (select *, stop - n a, greatest(stop - n - 34, 0) lo, least(stop + 34, length(text)) hi from o)
select doc_id, cast(a as int) as "start", {sentence_sql('a', 'stop')} sentence, case when lo > 0 then '…' else '' end || trim(regexp_replace(substr(text, lo + 1, hi - lo), '\\s+', ' ', 'g')) || case when hi < length(text) then '…' else '' end context from w""")
def q_context(spark, sf_dir):
    """The sentence and the window around every shout."""

    def told(table, n, o):
        places = F.struct(analyze.place(table, o["start"]).alias("a"), analyze.place(table, o["stop"]).alias("b"))
        sentence = lambda x: analyze.sentence_around(table, n, o["start"], x["a"]["sentence"], x["b"]["ends"])["text"]
        return F.struct(o["start"].alias("start"), let(places, sentence).alias("sentence"), analyze.window_around(table, n, o["start"], o["stop"]).alias("context"))

    return _each(docs(spark, sf_dir), "[A-Z]+!!", told)


FOUND_SQL = f"""{STATS}, r(rule, rule_ord, p) as (values ('shout', 0, '[A-Z]+!!'), ('the-word', 1, 'the [a-z]+'), ('percent-run', 2, '%%%'), ('long-word', 3, '[a-z]{{12,}}')),
m as (select doc_id, rule, rule_ord, regexp_extract_all(text, p) m, string_split(regexp_replace(text, p, chr(1), 'g'), chr(1)) g from d, r),
e as (select doc_id, rule, rule_ord, unnest(range(1, len(m) + 1)) k, unnest(m) v, unnest(g[1:len(m)]) gap from m),
o as (select doc_id, rule, rule_ord, cast(sum(length(gap) + length(v)) over (partition by doc_id, rule order by k) as bigint) stop, length(v) n from e),
a as (select doc_id, list(struct_pack(b := stop - n, e := stop, o := rule_ord) order by stop - n, -stop, rule_ord) l from o group by doc_id),
z as (select doc_id, list_reduce(list_prepend({{'b': 0::bigint, 'e': -1::bigint, 'o': -1, 'ks': []::struct(b bigint, e bigint, o int)[]}}, list_transform(l, lambda x: {{'b': x.b, 'e': x.e, 'o': x.o, 'ks': []::struct(b bigint, e bigint, o int)[]}})), lambda acc, x: case when x.b < acc.e then acc else {{'b': x.b, 'e': x.e, 'o': x.o, 'ks': list_append(acc.ks, struct_pack(b := x.b, e := x.e, o := x.o))}} end).ks ks from a),
sp as (select doc_id, u.b as "start", u.e stop, u.o rule_ord from (select doc_id, unnest(ks) u from z)),
cm as (select doc_id, len(regexp_extract_all(text, ',')) n, rate_words, case when rate_words > 0 then len(regexp_extract_all(text, ',')) / rate_words * 1000 else 0 end val from st where rate_words >= 250 and gate_sentences >= 5 and fn_words / rate_words >= 0.12),
dl as (select doc_id, n, rate_words, val, case when val >= 10 then cast(cast(floor(val + 0.5) as bigint) as varchar) else cast(floor(val * 100 + 0.5) / 100 as varchar) end shown from cm where val >= 60),
fd as (select doc_id, rule_ord, rule, "start", stop, false doc_level, 0 n_occ, null measure from sp join r using (rule_ord) union all
  select doc_id, 4, 'commas', strpos(text, ',') - 1, strpos(text, ','), true, n, n || ' in ' || rate_words || ' words, ' || shown || ' per 1000 >= 60' from dl join d using (doc_id))"""


SHOWN = "rule line col end_line end_col match sentence doc_level n_occurrences".split()


def found(spark, sf_dir, *fields):
    return findings.assemble(docs(spark, sf_dir), RULES, list(fields or findings.FIELDS))


@query("findings", f"with {FOUND_SQL} select doc_id, rule, {line_sql('\"start\"')} line, {col_sql('\"start\"')} col, {line_sql('stop')} end_line, {col_sql('stop')} end_col, substr(text, \"start\" + 1, stop - \"start\") as \"match\", {sentence_sql('\"start\"', 'stop')} sentence, doc_level, cast(n_occ as int) n_occurrences, measure from fd join d using (doc_id)")
def q_findings(spark, sf_dir):
    """Every finding of five rules with its place, sentence and measure; overlapping spans collapsed."""
    return found(spark, sf_dir, *SHOWN, "measure")


@query("findings_by_rule", f"with {FOUND_SQL} select rule, count(*) n, count(distinct doc_id) files from fd group by rule")
def q_by_rule(spark, sf_dir):
    """Findings by rule, and the files that hold them."""
    return findings.kept_spans(docs(spark, sf_dir), RULES).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("files"))


@query("finding_navigation", f"""with {FOUND_SQL}, nv as (select doc_id, "start", rule_ord, lag(doc_id) over w pd, lag("start") over w ps, lead(doc_id) over w nd, lead("start") over w ns from fd window w as (order by doc_id, "start", rule_ord)) select doc_id, cast("start" as int) as "start", cast(rule_ord as int) rule_ord, pd before_doc, cast(ps as int) before_start, nd after_doc, cast(ns as int) after_start from nv""")
def q_navigation(spark, sf_dir):
    """Every finding with the places of the ones before and after it, across documents."""
    nav = findings.navigation(findings.kept_spans(docs(spark, sf_dir), RULES), lambda df: saved(df, "navigation"))
    return nav.select("doc_id", "start", "rule_ord", F.col("before.doc_id").alias("before_doc"), F.col("before.start").alias("before_start"), F.col("after.doc_id").alias("after_doc"), F.col("after.start").alias("after_start"))


@query("rate_blocks", f"with {FOUND_SQL} select doc_id, shown as \"value\", 'per 1000 words' unit, '≥ 60' bound, n || case when n = 1 then ' occurrence' else ' occurrences' end || ' in ' || rate_words || ' words' sub from dl")
def q_rate_blocks(spark, sf_dir):
    """A10 V8: the rate of each document-level finding in the parts in which it is shown."""
    return findings.rates(docs(spark, sf_dir), RULES).select("doc_id", findings.rate_block(F.col("rate")).alias("b")).select("doc_id", "b.*")


@query("findings_lines", f"with {FOUND_SQL}, x as (select doc_id, rule, {line_sql('\"start\"')} line, {col_sql('\"start\"')} col, trim(regexp_replace(substr(text, \"start\" + 1, stop - \"start\"), '\\s+', ' ', 'g')) ma, case when rule = 'shout' then 'Say it once.' else '' end su from fd join d using (doc_id)) select doc_id, concat_ws(chr(9), doc_id, line, col, rule, ma) tsv, '::warning file=' || doc_id || ',line=' || line || ',col=' || col || ',title=' || rule || '::' || regexp_replace(trim(ma || ' · ' || su), '[\\r\\n%]', ' ', 'g') annotation from x")
def q_output_lines(spark, sf_dir):
    """K3 K4 K7: findings as tab-separated lines and as CI annotations."""
    rows = found(spark, sf_dir, "line", "col", "rule", "match", "suggest").withColumn("file", F.col("doc_id").cast("string"))
    return rows.select("doc_id", findings_tsv().alias("tsv"), findings_annotations().alias("annotation"))


@query("json_report", f"with {FOUND_SQL}, c as (select doc_id, count(*) k from fd group by 1) select cast(st.doc_id as varchar) as file, '{{\"file\":\"' || st.doc_id || '\",\"words\":' || ws_words || '}}' head, cast(coalesce(k, 0) as int) n_findings from st left join c using (doc_id)")
def q_json(spark, sf_dir):
    """K2: the JSON report, a line a file, read back as JSON."""
    rows = found(spark, sf_dir).withColumn("file", F.col("doc_id").cast("string"))
    stats = doc_stats(docs(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("file"), "ws_words")
    lines = findings.json_report(rows, stats, RULES).where("file is not null")
    head = F.to_json(F.from_json("line", "file string, words long"))
    return lines.select("file", head.alias("head"), F.size(F.from_json("line", "findings array<struct<rule string, line int>>")["findings"]).alias("n_findings"))


# The same rules with one whose matches run over the ends of lines.
LINE_END = {"id": "line-end", "match": {"kind": "regex", "pattern": "[a-z]+[.]?\\n+[A-Z]"}, "notable": {">": 0}}
LINE_RULES = rules.resolve([{"name": "lines", "rules": [LINE_END if r["id"] == "percent-run" else r for r in OWN["rules"]]}])
LINES_SQL = FOUND_SQL.replace("('percent-run', 2, '%%%')", "('line-end', 2, '[a-z]+[.]?\\n+[A-Z]')")


@query("highlight_lines", f"""with {LINES_SQL}, {PLACES.format(p=',').replace("p_ as", "cp as").replace("from p_", "from cp").replace("e_ as", "ce as").replace("from e_", "from ce").replace("o as (select doc_id, text, cast", "co as (select doc_id, text, cast")},
lc as (select doc_id, stop - co.n a, stop b from co join dl using (doc_id)), hi as (select doc_id, "start" a, stop b, 0 priority from sp union all select doc_id, a, b, 1 from lc where not exists (select 1 from sp where sp.doc_id = lc.doc_id and lc.a < sp.stop and sp."start" < lc.b)),
li as (select doc_id, text, a, priority, string_split(substr(text, a + 1, b - a), chr(10)) x, length(substr(text, 1, a)) - length(replace(substr(text, 1, a), chr(10), '')) l from hi join d using (doc_id)),
lq as (select doc_id, text, a, priority, l, x, unnest(range(1, len(x) + 1)) i from li), lz as (select doc_id, priority, l + i as line, a + i - 1 + coalesce(list_sum(list_transform(x[1:i-1], lambda y: length(y))), 0) as s, length(x[i]) n, string_split(text, chr(10))[l + i] whole from lq)
select doc_id, cast(line as int) line, cast(s as int) as "start", cast(s + n as int) stop, priority from lz where n > 0 and regexp_matches(whole, '\\S')""")
def q_highlights(spark, sf_dir):
    """What is marked in each line: kept spans of four rules, and commas behind a document's comma rate where they are free."""
    return findings.highlights(docs(spark, sf_dir), LINE_RULES)


# Two lists of the documents' commonest words, of the sizes and bounds of the two word-list rules.
LISTS = {"words-250": (250, 0.095), "words-1497": (1497, 0.31)}
TOKENS = "list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: lower(w)))"


@query("word_list_verdicts", f"""with {STATS}, {BAG_SQL}, ra as (select word, row_number() over (order by count(*) desc, word) r from bag group by word), li(rule, most, bound) as (values {', '.join(f"('{k}', {n}, {b})" for k, (n, b) in LISTS.items())}),
t as (select doc_id, unnest({TOKENS}) word from d), h as (select doc_id, rule, count(*) n from t join ra using (word) join li on r <= most group by all),
v as (select st.doc_id, li.rule, bound, coalesce(h.n, 0) n, case when rate_words > 0 then coalesce(h.n, 0) / pow(rate_words, 0.7) else 0 end x, rate_words, gate_sentences, fn_words from st cross join li left join h on h.doc_id = st.doc_id and h.rule = li.rule)
select doc_id, rule, n, cast(floor(x * 1e6 + 0.5) as bigint) value_millionths, x >= bound and n >= 10 and rate_words >= 600 and gate_sentences >= 5 and rate_words > 0 and fn_words / greatest(rate_words, 1) >= 0.12 fires from v""")
def q_word_lists(spark, sf_dir):
    """Lists of 250 and 1497 words judged in one scan, by looking tokens up."""
    ranked = corpus.vocabulary(bags(spark, sf_dir), 1).orderBy(F.desc("df"), "word").limit(max(n for n, _ in LISTS.values()))
    words = [r.word for r in ranked.collect()]  # the lists are part of the rules
    made = [{"id": k, "match": {"kind": "regex", "pattern": r"\b(?:" + "|".join(words[:n]) + r")\b", "flags": "i", "distinct": True}, "notable": {">=": bound, "power": 0.7, "needs": {"words": 600, "sentences": 5, "matches": 10}}} for k, (n, bound) in LISTS.items()]
    rows = rules.judged(docs(spark, sf_dir), rules.resolve([{"name": "lists", "rules": made}]))
    return rows.select("doc_id", "rule", F.col("n").cast("long").alias("n"), million(F.col("value")).alias("value_millionths"), F.col("bound").isNotNull().alias("fires"))


# ------------------------------------------------------------------ markup and the bundled rules


def pages(spark, sf_dir):
    """Every page as a source, with its text and runs."""
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("src"), F.lit("html").alias("kind"))
    return extracted(spread(rows))


@query("page_lineage")
def q_lineage(spark, sf_dir):
    """Every page's text, its runs, and how many runs do not hold the source's own characters (none should)."""
    wrong = F.filter("runs", lambda r: ~r["fixed"] & (F.substring(F.col("text"), r["o"] + 1, r["n"]) != F.substring(F.col("src"), r["s"] + 1, r["n"])))
    return pages(spark, sf_dir).select("doc_id", "text", F.size("runs").alias("n_runs"), F.size(wrong).alias("n_wrong"))


@query("page_findings")
def q_page_findings(spark, sf_dir):
    """Findings in pages, at their places in the HTML."""
    return findings.assemble(pages(spark, sf_dir), RULES, SHOWN)


@query("rule_self_test")
def q_self_test(spark, sf_dir):
    """The bundled rules on their examples, plain and with markup around the hit."""
    tried = [r for r in rules.resolve(rulebook.SETS, everything=True) if "tests" in r]
    return selftest.tallies(selftest.self_test(spark, tried))


@query("rule_governance")
def q_governance(spark, sf_dir):
    """Bundled rules whose suggestion lets a finding stand, or that are off without a reason."""
    rows = [(s["name"], s.get("role"), r["id"], r.get("suggest"), r.get("default"), r.get("offBecause")) for s in rulebook.SETS for r in s["rules"]]
    return evaluate.governance(spark.createDataFrame(rows, "`set` string, role string, rule string, suggest string, default string, off_because string"))


@query("rule_catalogue")
def q_catalogue(spark, sf_dir):
    """The catalogue of the bundled rules, a line a row."""
    return spark.createDataFrame(list(enumerate(publish.catalogue(rulebook.SETS).split("\n"))), "n int, line string")
