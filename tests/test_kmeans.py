from pyspark.sql import functions as F

from prosemill.operators import corpus


def test_known_counts_are_those_of_known_documents(spark):
    """Documents that repeat or lack an id included; five words are enough, four are not."""
    rows = [(i % 7 if i % 11 else None, f"w{i % 9}", i % 3 + 1) for i in range(200)] + [(50, f"w{i}", 1) for i in range(5)] + [(51, f"w{i}", 1) for i in range(4)]
    bags = spark.createDataFrame(rows, "doc_id long, word string, tf long")
    words = spark.createDataFrame([(f"w{i}",) for i in range(8)], "word string")
    long_form = corpus.known_documents(bags, words).groupBy("doc_id").agg(F.count("*").alias("known"), F.sum("tf").alias("tokens"))
    got = sorted(corpus.known_counts(bags, words).collect())
    assert got == sorted(long_form.collect()) and 50 in [r.doc_id for r in got] and 51 not in [r.doc_id for r in got] and None not in [r.doc_id for r in got]


def test_a_round_finds_each_cluster_once(spark, monkeypatch):
    """Fits end when their counts stand still, with the clusters of rounds without an end; a document's cluster is found once a round."""
    import numpy as np

    rows = [(d, f"w{(d * 7 + j * (1 + d % 3)) % 23}", 1 + (d * j) % 4) for d in range(60) for j in range(8)]
    bags = spark.createDataFrame(rows, "doc_id long, word string, tf long").groupBy("doc_id", "word").agg(F.sum("tf").alias("tf")).localCheckpoint()
    passes = []
    plain = corpus.drawn
    monkeypatch.setattr(corpus, "drawn", lambda *a: passes.append(1) or plain(*a))
    save = lambda df: df.localCheckpoint()
    got = {r.doc_id: (r.k3, r.k4) for r in corpus.kmeans_of(bags, [3, 4], 25, save=save).collect()}
    # the same rounds, plainly, with no end before the twenty-fifth
    ids, words = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    tf = np.zeros((len(ids), len(words)), np.int64)
    for d, w, n in rows:
        tf[ids.index(d), words.index(w)] += n
    u = dict(plain(bags.select("doc_id").distinct(), 12345, save).collect())
    for place, k in enumerate((3, 4)):
        cluster = np.array([int(u[d] * k) for d in ids])
        centres = np.repeat(tf[:1], k, axis=0).astype(float)
        for _ in range(25):
            counts = np.stack([tf[cluster == c].sum(axis=0) for c in range(k)])
            centres = np.where(counts.sum(axis=1, keepdims=True) > 0, counts, centres)
            cluster = (tf @ np.log((centres + 0.01) / (centres.sum(axis=1, keepdims=True) + 0.01 * len(words))).T).argmax(axis=1)
        assert [got[d][place] for d in ids] == cluster.tolist()
    assert len(passes) == 1


def test_fits_too_large_together_are_passes_of_their_own(spark, monkeypatch):
    """Several fits that exceed max_cells together, but not alone, are not joined by word."""
    rows = [(d, f"w{(d * 5 + j) % 17}", 1 + d % 3) for d in range(40) for j in range(6)]
    bags = spark.createDataFrame(rows, "doc_id long, word string, tf long")
    save = lambda df: df.localCheckpoint()
    monkeypatch.setattr(corpus, "_joined_kmeans", lambda *a: 1 / 0)
    one, several = (sorted(corpus.kmeans_of(bags, [2, 3], 5, save=save, max_cells=n).collect()) for n in (1000, 60))
    assert one == several


def _rows(spark, n=90):
    """Rows with a bag each; ids repeat or are missing, and some bags are empty or null."""
    from prosemill.operators.corpus import word_counts

    texts = [(d % 80 if d % 13 else None, [f"w{(d * 7 + j * (1 + d % 4)) % 31:02}" for j in range(d % 17)] if d % 19 else None) for d in range(n)]
    return spark.createDataFrame(texts, "doc_id long, t array<string>").select("doc_id", word_counts(F.col("t")).alias("bag")).localCheckpoint()


def test_f1_large_centres_are_counted_in_parts(spark, monkeypatch):
    """Centres of more than max_cells numbers are not joined by word; parts meet at any cell."""
    rows = [(d, f"w{(d * 5 + j) % 17}", 1 + d % 3) for d in range(40) for j in range(6)]
    bags = spark.createDataFrame(rows, "doc_id long, word string, tf long")
    save = lambda df: df.localCheckpoint()
    want = sorted(corpus.kmeans_of(bags, [2, 3], 5, save=save).collect())
    monkeypatch.setattr(corpus, "_joined_kmeans", lambda *a: 1 / 0)
    monkeypatch.setattr(corpus, "PART", 7, raising=False)
    assert sorted(corpus.kmeans_of(bags, [2, 3], 5, save=save, max_cells=20).collect()) == want
    assert sorted(corpus.kmeans_of(bags, [2, 3], 5, save=save, max_cells=4).collect()) == want  # a pass each


def test_f1_counts_of_any_size_are_sent(spark, monkeypatch):
    """Parts of one to eight bytes a number, the last one shorter than the others."""
    times = [1, 200, 300, 70_000, 5_000_000_000]
    rows = [(d, f"w{j}", times[j] + d) for d in range(12) for j in range(5)]
    bags = spark.createDataFrame(rows, "doc_id long, word string, tf long")
    packed = bags.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("word", "tf"))).alias("p")).select("doc_id", F.expr("array(0, 1, 2, 3, 4)").alias("i"), F.col("p.tf").alias("tf")).localCheckpoint()
    monkeypatch.setattr(corpus, "PART", 2)
    fits = corpus._PackedFits(packed, 5, 5, [1], 2, 12345, lambda df: df.localCheckpoint(), 100)
    assert fits.counted(None, [1])[1][:, 0].tolist() == [sum(t + d for d in range(12)) for t in times]
    widths = {len(r.n) // (1 if r.part == 2 else 2) for r in fits.parts(None, [1]).collect()}
    assert widths == {2, 4, 8}


def test_f1_fits_of_rows_are_those_of_their_postings(spark, monkeypatch):
    """Repeated and missing ids, empty bags, words outside the vocabulary; postings are not shuffled by themselves."""
    rows, save, ks = _rows(spark), lambda df: df.localCheckpoint(), [2, 4]
    long_form = rows.select("doc_id", F.inline("bag"))
    words = save(corpus.vocabulary(long_form, 16).select("word"))
    assert 5 < words.count() < 31
    known = save(corpus.known_documents(long_form, words).select("doc_id", "word", "tf"))
    want = sorted(corpus.kmeans_of(known, ks, save=save).collect())
    none = corpus.kmeans_rows(rows.limit(0), words.limit(0), ks, save=save)
    with monkeypatch.context() as m:
        m.setattr(corpus, "known_documents", lambda *a: 1 / 0)
        assert sorted(corpus.kmeans_rows(rows, words, ks, save=save).collect()) == want and none.collect() == []
    # the vocabulary that is too large for a broadcast gives the same
    assert sorted(corpus.kmeans_rows(rows, words, ks, save=save, max_cells=0).collect()) == want


def test_f3_scores_add_up_in_the_order_of_the_words(spark):
    """To the last bit the sums of a plain loop, for many documents of a place and for few long ones."""
    import numpy as np

    rng = np.random.default_rng(1)
    model = np.log(rng.random((50, 3)) + 0.01)
    n = sorted([*rng.integers(1, 30, 60).tolist(), 2500, 1100], reverse=True)
    docs = [(rng.integers(0, 50, k).tolist(), rng.integers(1, 400, k).tolist()) for k in n]
    packed = spark.createDataFrame([(d, 0.5, *x) for d, x in enumerate(docs)], "doc_id long, u double, i array<int>, tf array<long>").coalesce(1)
    seen = []
    for batch in corpus._blocks(packed, 2000).toArrow().to_batches():
        for _, lengths, word, times, ids in corpus._unpacked(batch):
            for d, got in zip(ids.to_pylist(), corpus._scores(model, lengths, word, times.astype(np.float64)), strict=True):
                plain = np.zeros(3)
                for i, tf in zip(*docs[d], strict=True):
                    plain += tf * model[i]
                assert (plain == got).all()
                seen.append(d)
    assert sorted(seen) == list(range(62))


def test_f3_vocabulary_of_rows(spark):
    rows = _rows(spark)
    assert sorted(corpus.row_vocabulary(rows, 12).collect()) == sorted(corpus.vocabulary(rows.select(F.inline("bag")), 12).collect())


def test_f2_words_inside_clusters(spark):
    """The counts of a report are those of the postings joined with the fit, with parts or by words; so is the lift."""
    rows, save = _rows(spark), lambda df: df.localCheckpoint()
    long_form = rows.select("doc_id", F.inline("bag"))
    words = save(corpus.vocabulary(long_form, 16).select("word"))
    known = save(corpus.known_documents(long_form, words).select("doc_id", "word", "tf"))
    for most in (2_000_000, 0):
        fit, inside = corpus.kmeans_rows(rows, words, [3], save=save, max_cells=most, inside=3)
        joined = known.join(save(fit.withColumnRenamed("k3", "cluster")), "doc_id")
        assert sorted(inside.collect()) == sorted(joined.groupBy("cluster", "word").agg(F.count("*").alias("inside")).collect())
        sizes = fit.groupBy(F.col("k3").alias("cluster")).agg(F.count("*").alias("size"))
        assert sorted(corpus.lift_of(inside, sizes, "cluster").collect()) == sorted(corpus.lift_rank(joined, "cluster").collect())
