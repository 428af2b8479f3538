"""The day archive: publication by day, rewrites, pruned reads, writers that fail or meet."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from prosemill.operators import corpus
from prosemill.sources import archive

ROWS = [(date(2024, 1, d), k, f"a{k % 3}", k % 2 == 0, w, 1 + k % 2) for d in range(1, 11) for k in range(6) for w in ("one", "two", f"d{d}", f"k{k % 4}")]
SCHEMA = "day date, doc_id long, author string, signed boolean, word string, tf long"


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/archive"


def rows_of(df):
    return sorted(tuple(r[c] for c in ("day", "doc_id", "author", "signed", "word", "tf")) for r in df.collect())


def partitions_read(df):
    """The partition filters of the posting scan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PartitionFilters: \[(.*?)\], (?:PushedFilters|DataFilters|Location)", plan) or re.findall(r"PartitionFilters: \[(.*?)\]\s*,", plan)


def test_write_rewrite_and_read_a_window(spark, path):
    all_rows = spark.createDataFrame(ROWS, SCHEMA)
    archive.write_days(all_rows.where("day <= date'2024-01-06'"), path)
    assert rows_of(archive.read_days(spark, path)) == sorted(r for r in ROWS if r[0] <= date(2024, 1, 6))
    # days that are there stay, new ones come in
    archive.write_days(all_rows.withColumn("tf", F.lit(9)), path)
    held = rows_of(archive.read_days(spark, path))
    assert {r[5] for r in held if r[0] <= date(2024, 1, 6)} == {1, 2} and {r[5] for r in held if r[0] > date(2024, 1, 6)} == {9}
    # one day anew: that day alone changes
    archive.write_days(all_rows.where("day = date'2024-01-03' and doc_id < 2").withColumn("tf", F.lit(7)), path, force=True)
    got = rows_of(archive.read_days(spark, path, "2024-01-02", "2024-01-04"))
    assert got == sorted([r for r in ROWS if r[0] in (date(2024, 1, 2), date(2024, 1, 4))] + [(*r[:5], 7) for r in ROWS if r[0] == date(2024, 1, 3) and r[1] < 2])


def test_reads_are_pruned(spark, path):
    archive.write_days(spark.createDataFrame(ROWS, SCHEMA), path)
    window = archive.read_days(spark, path, "2024-01-02", "2024-01-03")
    assert any("day" in f and ">=" in f for f in partitions_read(window)) and "dynamicpruning" in window._jdf.queryExecution().executedPlan().toString().lower()
    some = archive.read_days(spark, path, days=spark.createDataFrame([(date(2024, 1, 5),), (date(2030, 1, 1),)], "day date"))
    assert {r[0] for r in rows_of(some)} == {date(2024, 1, 5)}
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString().lower()


def test_what_no_manifest_names_is_not_read(spark, path):
    """A writer that died before its manifest, and one that published a day twice, leave rows that no reader sees."""
    archive.write_days(spark.createDataFrame(ROWS, SCHEMA), path)
    spark.createDataFrame(ROWS, SCHEMA).withColumn("stamp", F.lit("dead")).write.mode("append").partitionBy("day", "stamp").parquet(f"{path}/postings")
    archive.write_days(spark.createDataFrame(ROWS, SCHEMA).where("doc_id = 1"), path, force=True)
    archive.write_days(spark.createDataFrame(ROWS, SCHEMA).where("doc_id = 2"), path, force=True)
    assert {r[1] for r in rows_of(archive.read_days(spark, path))} == {2}


def test_summaries_and_windows(spark, path):
    assert archive.summaries(spark, path).count() == 0
    archive.write_days(spark.createDataFrame(ROWS, SCHEMA), path)
    got = {r.day: r for r in archive.summaries(spark, path).collect()}
    assert len(got) == 10 and all((r.docs, r.signed_docs, r.signed_authors, r.unsigned_authors, r.words, r.postings) == (6, 3, 3, 3, 7, 24) for r in got.values())
    words = {r.word for r in archive.window(spark, path, "2024-01-01", "2024-01-02", 7).select("word").distinct().collect()}
    assert words == {"one", "two"}


def test_postings_of_days(spark):
    """Words of two documents of their day; documents with two such words."""
    d = spark.createDataFrame([(date(2024, 1, 1), 1, ["a", "b", "a", "c"]), (date(2024, 1, 1), 2, ["a", "b", "d"]), (date(2024, 1, 1), 3, ["a"]), (date(2024, 1, 2), 4, ["a", "b"]), (date(2024, 1, 2), 5, [])], "day date, doc_id long, tokens array<string>")
    got = sorted((r.doc_id, r.word, r.tf) for r in corpus.day_archive(d, min_df=2, least=2).collect())
    assert got == [(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "b", 1)]


def test_words_are_counted_inside_their_row(spark):
    d = spark.createDataFrame([(1, ["b", "a", "b", None, "b"]), (2, []), (3, None), (1, ["a"])], "doc_id long, tokens array<string>")
    got = sorted(((r.doc_id, r.word, r.tf) for r in corpus.bag(d, "doc_id").collect()), key=str)
    assert got == sorted([(1, "a", 1), (1, "b", 3), (1, None, 1), (1, "a", 1)], key=str)


def test_bots_stay_out(spark):
    """Logins of bots, and no others."""
    logins = ["dependabot[bot]", "renovate-x", "x-bot", "github-actions", "copilot", "Copilot-user", "robot", "ann", None]
    d = spark.createDataFrame([(x,) for x in logins], "login string")
    assert {r.login for r in corpus.without_bots(d, "login").collect()} == {"Copilot-user", "robot", "ann", None}


def test_pairs_of_a_folder(spark, tmp_path):
    """Sides and registers from the names, short texts out."""
    from prosemill.sources.files import read_pairs

    for side in ("human", "ai"):
        (tmp_path / side).mkdir()
        (tmp_path / side / "essay-one.txt").write_text("word " * 250)
        (tmp_path / side / "mail-two.txt").write_text("word " * (249 if side == "ai" else 251))
    (tmp_path / "human" / "essay-three.md").write_text("word " * 300)
    (tmp_path / "other.txt").write_text("word " * 300)
    got = sorted((r.pair_id, r.register, r.side) for r in read_pairs(spark, str(tmp_path)).collect())
    assert got == [("essay-one", "essay", "ai"), ("essay-one", "essay", "human"), ("mail-two", "mail", "human")]


def test_bags_by_day_are_what_postings_by_day_are(spark, path):
    """Words of one document alone go, in repeated ids and long bags as well; neither way of writing differs."""
    rows = [(date(2024, 1, 1 + k % 3), None if k == 9 else k // 2, "ab"[k % 2], k % 2 == 0, [(f"w{(k * j) % 23}", 1 + j) for j in sorted({(k * j) % 23: j for j in range(k + 3)}.values())]) for k in range(40)]
    rows = [(*r[:4], sorted({w: n for w, n in r[4]}.items())) for r in rows] + [(None, 77, "c", True, [("w1", 1)]), (date(2024, 1, 1), 88, "c", True, [(f"u{i}", 1) for i in range(3000)] + [("w1", 2)])]
    bags = spark.createDataFrame(rows, "day date, doc_id long, author string, signed boolean, bag array<struct<word string, tf long>>")
    apart = bags.where("doc_id is not null").selectExpr("day", "doc_id", "author", "signed", "inline(bag)")
    for least in (1, 5, 9):
        got = corpus.day_bags(bags, least)
        assert rows_of(got.selectExpr("day", "doc_id", "author", "signed", "inline(bag)")) == rows_of(corpus.day_postings(apart, 2, least))
    archive.write_days(corpus.day_bags(bags), path)
    archive.write_days(corpus.day_postings(apart), f"{path}-apart")
    assert rows_of(archive.read_days(spark, path)) == rows_of(archive.read_days(spark, f"{path}-apart"))
    assert sorted(archive.summaries(spark, path).collect()) == sorted(archive.summaries(spark, f"{path}-apart").collect())


def test_a_window_is_counted_without_a_join_of_its_words(spark, path):
    """A frequent word's postings met their word in one partition; now they are summed where they are read."""
    archive.write_days(spark.createDataFrame(ROWS, SCHEMA), path)
    got = archive.window_words(spark, path, "2024-01-01", "2024-01-02", 7)
    assert sorted(tuple(r) for r in got.collect()) == [("one", 12, 18), ("two", 12, 18)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" in plan.split("Join")[0]


def test_tokens_as_by_the_rule_of_three_letters(spark):
    """Runs trimmed in one pass are those trimmed by patterns one after the other."""
    from prosemill.functions.text import corpus_tokens

    text = "_/ab-c_/- a_b_c 12-34 abc1 --- x/y/z/ _-_abc-_- ab 1a2b3c <b>gone</b> https://x.y/z left-- éabcé /_-/_foo"
    got = spark.createDataFrame([(text,)], "text string").select(corpus_tokens(F.col("text"))).head()[0]
    rest = re.sub(r"<[a-z/!][^<>]*>", " ", re.sub(r"""https?://[^\s<>"'`)\]}]+""", " ", text.lower()))
    raw = [re.sub(r"-+\Z", "", re.sub(r"[_/]+\Z", "", re.sub("^[_/]+", "", w))) for w in re.findall(r"[a-z0-9_/-]*[a-z][a-z0-9_/-]*", rest)]
    assert got == [w for w in raw if len(re.findall("[a-z]", w)) >= 3]
