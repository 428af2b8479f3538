"""Published data, governance, claims and the k sweep."""

from pyspark.sql import functions as F

from prosemill.operators import corpus, evaluate, publish


def test_governance(spark):
    rows = [("a", None, "x", "There is no need to act.", None, None), ("a", None, "y", "Cut it.", "off", None), ("a", None, "z", "Cut it.", "off", "noisy"), ("b", "style", "s", None, "off", None), ("c", None, "t", None, "off", None), ("c", None, "u", None, "off", None)]
    got = evaluate.governance(spark.createDataFrame(rows, "`set` string, role string, rule string, suggest string, default string, off_because string"))
    assert sorted((r.rule, r.problem) for r in got.collect()) == [("x", "suggestion permits"), ("y", "off without a reason")]


def test_published_lines_go_stale(spark):
    t = spark.createDataFrame([("x", 1), ("y", 2)], "w string, n int")
    old, new = publish.sections(words=t), publish.sections(words=t.withColumn("n", F.when(F.col("w") == "y", 3).otherwise(F.col("n"))))
    assert publish.stale(old, old).count() == 0
    assert sorted((r.line, r.state) for r in publish.stale(old, new).collect()) == [('{"w":"y","n":2}', "outdated"), ('{"w":"y","n":3}', "missing")]


def test_catalogue(tmp_path):
    sets = [{"name": "s", "title": "T", "description": "a | b", "rules": [{"id": "x", "description": "d\n e", "suggest": None}]}]
    text = publish.catalogue(sets)
    assert "| `x` | d e |  |" in text and r"a \| b" in text and text.endswith("1 rules in 1 sets.\n")
    (tmp_path / "c.md").write_text(text, "utf-8")
    assert publish.catalogue_is_current(sets, str(tmp_path / "c.md")) and not publish.catalogue_is_current([], str(tmp_path / "c.md"))


def test_both_ways_of_kmeans_and_the_sweep(spark):
    rows = [(i, f"{'ab'[i % 2]}{(i * k) % 7}", k) for i in range(60) for k in (1, 2, 3)]
    bags = spark.createDataFrame(rows, "doc_id long, word string, tf long").groupBy("doc_id", "word").agg(F.sum("tf").alias("tf")).cache()
    save = lambda df: df.cache()
    packed, joined = ({r.doc_id: r.cluster for r in corpus.kmeans(bags, 3, save=save, max_cells=n).collect()} for n in (1000, 0))
    assert packed == joined and len(packed) == 60
    info = bags.select("doc_id").distinct().select("doc_id", F.expr("date_add(date'2024-01-01', cast(7 * (doc_id % 10) as int))").alias("week"), F.expr("doc_id % 2 = 0").alias("signed"))
    judged = corpus.judge_fits(corpus.sweep(bags, info, [2, 3], save)).collect()
    assert [r.k for r in sorted(judged)] == [2, 3] and all(r.admitted == 0 and r.growth is None and not r.agree for r in judged)


def test_the_generator_is_looked_up(spark):
    """Any place of the generator's run, tail and cycle, without walking there."""
    states, cycle = corpus.generator_states(12345)
    s = 12345
    for i in range(3 * len(states)):
        assert states[i if i < len(states) else cycle + (i - cycle) % (len(states) - cycle)] == s
        s = int(float(s) * 1103515245.0 + 12345.0) & 0xFFFFFFFF
    ids = spark.range(20_000).select((F.col("id") * 7 % 20_011).alias("doc_id")).repartition(5)
    got = [r.u for r in corpus.drawn(ids, 12345, lambda df: df.cache()).orderBy("doc_id").collect()]
    s, want = 12345, []
    for _ in range(20_000):
        s = int(float(s) * 1103515245.0 + 12345.0) & 0xFFFFFFFF
        want.append(s / 4294967296.0)
    assert got == want


def test_fits_together_equal_fits_alone(spark):
    rows = [(i, f"{'abc'[i % 3]}{(i * k) % 11}", 1 + i % 2) for i in range(80) for k in (1, 2, 3, 5)]
    bags = spark.createDataFrame(rows, "doc_id long, word string, tf long").groupBy("doc_id", "word").agg(F.sum("tf").alias("tf")).cache()
    save = lambda df: df.cache()
    together = {r.doc_id: (r.k2, r.k3, r.k5) for r in corpus.kmeans_of(bags, [2, 3, 5], save=save).collect()}
    alone = [{r.doc_id: r.cluster for r in corpus.kmeans(bags, k, save=save).collect()} for k in (2, 3, 5)]
    assert together == {i: tuple(a[i] for a in alone) for i in together} and len(together) == 80
    nothing = corpus.kmeans_of(bags.limit(0), [2, 3], save=save)
    assert nothing.collect() == []
