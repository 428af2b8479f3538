"""The corpus pipeline on a small folder of tables, stage by stage against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from prosemill.llm import decontaminate, mixing


def words(rng, n):
    return [f"w{int(rng.random() ** 2 * 400)}" for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    items = [[f"q{rng.randrange(300)}" for _ in range(20)] for _ in range(3)]
    rows = []
    for i in range(160):
        bad = i % 8 == 0
        w = words(rng, 60)
        if i % 10 == 3:
            w = rows[i - 2][1].split()[:60]  # a near copy
            w[5] = "changed"
        if i % 20 == 7:
            w += items[i % 3][:10] + ["more"] + items[i % 3][10:]
        rows.append((i, " ".join(x + "!!" * bad for x in w), "en" if i % 3 else "de", f"s{i % 4}"))
    rows += [(5, rows[5][1], "en", "s1"), (6, "other text of a repeated id " + " ".join(words(rng, 50)), "en", "s2"), (None, " ".join(words(rng, 50)), None, None), (900, None, "en", "s1"), (901, "", "en", "s1")]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, items int")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 0), 0) for i in range(0, 160, 2)] + [(i, int(i % 8 != 0), 0) for i in range(1, 160, 4)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain(t):
    return (t or "").encode().lower().split()


def test_stages(spark, folder):
    tokenizers, lib = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "near-duplicates", "decontamination", "mixing", "token files"]
    (_, classify), (_, dedup), (_, clean), (_, mix), (_, tokens) = P.STAGES

    good = classify(spark, docs, folder).cache()
    assert good.columns == docs.columns
    left = {r.doc_id for r in good.collect()}
    assert sum(i in left for i in range(160) if i % 8) >= 135 and sum(i in left for i in range(0, 160, 8)) <= 2

    one = dedup(spark, good, folder).cache()
    assert one.columns == docs.columns
    before = sorted({(r.doc_id, r.text) for r in good.collect()}, key=str)
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := plain(t)) else set() for _, t in before]
    label = list(range(len(before)))
    for a in range(len(before)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                label = [label[a] if x == label[b] else x for x in label]
    of = dict(zip(before, label, strict=True))
    kept = [(r.doc_id, r.text) for r in one.collect()]
    assert Counter(of[k] for k in kept) == Counter(dict.fromkeys(label, 1))

    free = clean(spark, one, folder).cache()
    assert free.columns == docs.columns
    items = [r.text.split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    number = {w: k for k, w in enumerate({w for _, t in kept for w in (t or "").lower().split()} | {w for x in items for w in x})}
    as_array = lambda ws: np.array([number[w] for w in ws], np.int64)
    dirty = {k for k in kept if any(decontaminate.edit_distance_inside(as_array(x), as_array((k[1] or "").lower().split())) <= len(x) // 5 for x in items)}
    assert dirty and {(r.doc_id, r.text) for r in free.collect()} == set(kept) - dirty

    mixed = mix(spark, free, folder).cache()
    assert mixed.columns == docs.columns
    supply = Counter()
    for r in free.collect():
        supply["longform" if r.n_chars >= 4000 else "shortform", r.lang or "", r.source or ""] += len(plain(r.text))
    want = mixing.budgets(dict(supply), mixing.WEIGHTS, int(0.8 * sum(supply.values())), 2)
    got = Counter()
    for r in mixed.collect():
        got["longform" if r.n_chars >= 4000 else "shortform", r.lang or "", r.source or ""] += len(plain(r.text))
    assert all(want[p] - 60 < got[p] <= want[p] for p in supply if supply[p])

    out = tokens(spark, mixed, folder).collect()
    enc = tokenizers.Tokenizer.from_file(lib.path("word_bpe_49k.json"))
    ids = lambda t: [*enc.encode(t or "", add_special_tokens=False).ids, 1]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r in mixed.collect() for x in [ids(r.text)])
    assert sorted(r.start for r in out)[0] == 0


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.count() == 0 and (name == "token files" or out.columns == docs.columns)


def test_kept_documents_meet_no_scores_by_a_join(spark, folder):
    """Texts stay where they were read: a join with the scores shuffled all of them once a side was too large to broadcast."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    good = P.classify(spark, docs, folder)
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    kept = P.cotrain.score_documents(docs, labels).where("kept").join(docs.select("doc_id", "text"), "doc_id")
    unique = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 1 and doc_id is not null").select("doc_id")
    both = lambda rows: sorted(r.doc_id for r in rows.join(unique, "doc_id").select("doc_id").collect())
    assert both(good) == both(kept)
    none = P.cotrain.good_documents(docs.limit(0), labels)
    assert none.count() == 0 and none.schema == docs.schema
