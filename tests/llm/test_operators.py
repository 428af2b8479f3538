"""The ten operators against brute force on small tables: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemill.llm import cotrain, decontaminate, minhash, mixing, pitman_yor, privacy, quality_rules, suffix_dedup, tokens, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n long, hash long"


def words(rng, n, size=200):
    return " ".join(f"w{int(rng.random() ** 2 * size)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 120)) for _ in range(60)]
    copies = [b.replace("w7 ", "zz ", 1) for b in base[:25]]
    texts = [*base, *copies, *base[:10], None, "", "   ", "one", "Ab, " * 300, "x" * 700, base[3] + " " + words(rng, 4000, 3000) + " " + base[4], base[5] * 3, "é😀 " * 60]
    rows = [(i, t, ("en", "de", None)[i % 3], f"src{i % 4}", None if t is None else len(t), 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").encode().lower().split()


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = rng.integers(0, 40, n).astype(np.uint32)
        ids[rng.random(n) < 0.05] = 2**32 - 1
        blocks = tokens.encode_blocks(ids)
        offsets = np.cumsum([0, *map(len, blocks)])[:-1]
        assert (tokens.decode_blocks(b"".join(blocks), offsets) == ids).all()


def test_token_files(spark, docs, rows, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib, at, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    for i in sorted(rows):
        ids = [*lib.encode(rows[i] or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokens.token_files(spark, docs).collect())) == want
    assert tokens.token_files(spark, empty).count() == 0


def test_encoder_equals_library():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), tokens.WordEncoder(P.path("word_bpe_49k.json"))
    for t in ["It's the CAFÉ, isn't.", "a b c\x1cd", "<|endoftext|> <|ENDOFTEXT|>. x<|startoftext|>y", "Café. É, 1.5, ...", "ΑΣ. Σ, ß.", "≠ a.́ ,,. don't."]:
        assert own.encode([t], 1)[0].tolist() == [*lib.encode(t, add_special_tokens=False).ids, 1], t


def test_pitman_yor(docs, rows, empty):
    got = {r.doc_id: r for r in pitman_yor.score(docs).collect()}
    seq = {i: [*lower(t), None] for i, t in rows.items()}
    away = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    c = Counter(w for i in rows if not away[i] for w in seq[i])
    n, v = sum(c.values()), len(c)
    for i in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (away[i], len(seq[i]), sum(w in c for w in seq[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in seq[i]))
        assert r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    assert sum(r.score for r in got.values() if not r.held_out) > sum(r.base_score for r in got.values() if not r.held_out)
    assert pitman_yor.score(empty).count() == 0


def test_pitman_yor_predictive_sums_to_one():
    rng = np.random.default_rng(2)
    word, ctx = np.divmod(np.arange(50 * pitman_yor.CONTEXTS), pitman_yor.CONTEXTS)
    keep = ctx < 6
    word, ctx = word[keep], ctx[keep]
    count = rng.poisson(rng.gamma(0.3, 4, len(word))).astype(float)
    count[ctx == 0] += 1
    cells = pitman_yor.Cells(word, ctx, count, 50, 3)
    g, sums = pitman_yor._constants(cells.stats(), 1.0, 10.0)
    history = [sums]
    for _ in range(2):
        *_, last = cells.samples(g, list(history))
        history.append(cells.sums(*last))
    unknown = np.zeros(6)
    p = 10 ** cells.log_probability(g, history)
    total = np.bincount(ctx, p, 6)
    absent = (cells.word_count == 0).sum()
    assert absent == 0
    # the unknown word has the rest
    for (t, _), s in zip(cells.samples(g, history[:-1]), history[1:], strict=True):
        p0 = (g["s0"] + g["d0"] * s[-1]) * g["base"] / (g["s0"] + s[-2])
        unknown = unknown + (g["s"] + g["d"] * s[:6]) * p0 / (g["s"] + g["customers"][:6])
    assert np.allclose(total + unknown / 2, 1)


def test_pitman_yor_contexts_do_not_share(spark):
    # words of one 12-bit hash class, each always before a word of its own
    some = [f"k{i}" for i in range(160_000)]
    h, _ = pitman_yor.Hasher().words([" ".join(some).encode()])
    key = [some[i] for i in np.flatnonzero((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52) == 7)]
    assert len(key) > 20
    d = spark.createDataFrame([(i, f"{w} v{n} " * 6) for n, w in enumerate(key) for i in range(20 * n, 20 * n + 20)], "doc_id long, text string")
    got = pitman_yor.score(d).collect()
    # a follower has most of the probability after its word; in a shared restaurant about one part in len(key)
    assert len(got) == 20 * len(key) and all(r.score > -6 for r in got)


def brute_components(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, rows, empty, size):
    sets = {}
    for i, t in rows.items():
        w = lower(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    want = brute_components(sets, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, size).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert minhash.near_duplicates(empty, size).count() == 0


@pytest.mark.parametrize("few, tile", [(12, 8_000_000), (2, 64), (1, 1)])
def test_blocks_of_full_sets(few, tile, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "TILE", tile)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in rng.integers(1, 60, 40)] + [np.zeros(0, np.uint64)]
    own = rng.integers(0, 2, len(sets))
    left, right = np.flatnonzero(own == 0), np.flatnonzero(own == 1)
    assert minhash.common_counts(sets, left, right).tolist() == [[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left]
    rows = [(100 + k, 100 + k // 2, s) for k, s in enumerate(sets[:-1])]
    found = minhash.joining_links(rows, own[:-1], 0, 1, 40)
    parent = {r[1]: r[1] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        x, y = find(100 + (a - 100) // 2), find(100 + (b - 100) // 2)
        assert x != y
        parent[x] = y
    for a in left:
        for b in right[right < 40]:
            if a < 40:
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 40 * (len(sets[a]) + len(sets[b]) - both):
                    assert find(100 + a // 2) == find(100 + b // 2)


def test_buckets_cut_into_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 3)
    sets = {i: {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if (w := lower(t)) else set() for i, t in rows.items()}
    want = brute_components(sets, 30)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 2, 90).collect()} == brute_components(sets, 90)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 2, 30).collect()}
    assert all(want[i] == want[c] for i, c in got.items())


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_near_duplicates_of_repeated_and_null_ids(spark, parts):
    a, b, c = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("a", 40), ("b", 30), ("c", 50)))
    rows = [(1, a), (1, b), (2, a), (3, b), (3, b), (4, c), (None, c), (None, None), (5, None), (5, a)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0, r.kept) for r in minhash.near_duplicates(d, 2).collect())
    # the text of 1 is the shorter b, that of 5 the empty one
    assert got == [(0, 0, 0, True), (0, 49, 0, True), (1, 29, 1, True), (2, 39, 2, True), (3, 29, 1, False), (4, 49, 4, True), (5, 0, 5, True)]


def test_sketch_agrees_with_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    same = [(minhash.sketch(x[:900]) == minhash.sketch(x[100 - 100 * (k == 0) :])).mean() for k in (0, 1)]
    assert abs(same[0] - 0.9) < 0.12 and abs(same[1] - 0.8) < 0.15
    assert (minhash.sketch(x[:1]) != 0).all()


def test_classifier(spark, empty):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        bad, toxic = i % 5 == 0, i % 7 == 0
        t = " ".join(f"{w}!!" if bad else w for w in words(rng, 60).split())
        rows.append((i, t + (" vile" if toxic else ""), "en", f"s{i % 3}", len(t), int(not bad), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, toxic int")
    labels = table.select("doc_id", "quality", "toxic").where("doc_id % 2 = 0")
    d = table.select("doc_id", "text", "lang", "source", "n_chars")
    got = {r.doc_id: r.kept for r in cotrain.score_documents(d, labels).collect()}
    right = [got[r[0]] == (r[5] == 1 and r[6] == 0) for r in rows if r[0] % 2]
    assert sum(right) / len(right) > 0.9
    assert cotrain.score_documents(empty, labels).count() == 0
    assert all(r.kept for r in cotrain.score_documents(d, labels.limit(0)).collect())
    # columns of any name stay as they are; nulls and repeated ids have scores of their own
    odd = d.where("doc_id < 40").select("*", F.lit("a").alias("kept"), F.lit(1).alias("idx"), F.lit(2).alias("c0"), F.lit(3).alias("score"))
    odd = odd.unionByName(odd.where("doc_id = 3")).unionByName(spark.createDataFrame([(None, None, None, None, None, "a", 1, 2, 3), (3, "", "en", None, 0, "a", 1, 2, 3)], odd.schema))
    good = cotrain.good_documents(odd, labels)
    assert good.columns == odd.columns and {(r.kept, r.idx, r.c0, r.score) for r in good.collect()} == {("a", 1, 2, 3)}
    assert cotrain.score_documents(odd.drop("kept", "idx", "c0", "score"), labels).count() == odd.count() == 43


def test_classifier_learns_from_all_unlabelled_documents(spark):
    rng = random.Random(2)

    def row(i, bad):
        # "vile" occurs in documents without a label only; the text view learns it from the metadata view
        t = words(rng, 40) + (" poor" if bad and rng.random() < 0.7 else "") + (" vile" if bad and i >= 200 else "")
        return (i, t, "en", "bad" if bad else f"s{i % 3}", len(t))

    rows = [row(i, i % 4 == 0) for i in range(3000)]
    rows += [(5000 + 2 * k + v, rows[k + 1][1] + " vile" * v, "en", "s1", 99) for k in range(0, 400, 4) for v in (0, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.text_score for r in cotrain.score_documents(d, labels, per_round=0.2).collect()}
    lower_ = [got[i + 1] < got[i] or got[i] > 1 - 1e-9 for i in range(5000, 5800, 8)]
    assert all(lower_) and sum(got[i] - got[i + 1] for i in range(5000, 5800, 8)) > 0


def test_quotas_take_the_surest():
    counts = np.zeros((2, 2, cotrain.LAST))
    counts[0, 0, [3, 7, 9]] = 5, 4, 2
    counts[0, 1, 5] = 100
    assert cotrain.quotas(counts, 6).tolist() == [[4, 5], [cotrain.LAST, cotrain.LAST]]


def test_urls(spark):
    import datetime as dt

    day = dt.date.fromisoformat
    caps = spark.createDataFrame([(1, "http://a.b.c/x", day("2024-02-01")), (1, "http://a.b.c/x", day("2024-02-01")), (2, "https://A.b.c:80", day("2024-04-01")), (3, None, day("2024-02-01")), (4, "http://b.c", None), (5, "nonsense", day("2024-02-01")), (6, "http://xb.c/", day("2024-02-01"))], "page_id long, url string, fetched_on date")
    entries = spark.createDataFrame([("b.c", day("2024-01-01"), "block"), ("b.c", day("2024-03-01"), "unlist"), ("a.b.c", day("2024-03-15"), "block"), ("b.c", day("2024-01-01"), "unlist")], "key string, listed_on date, action string")
    got = sorted((r.page_id, r.matched_key, r.kept) for r in urls.filter_urls(caps, entries).collect())
    assert got == [(1, "b.c", False), (1, "b.c", False), (2, "a.b.c", False), (3, None, True), (4, None, True), (5, None, True), (6, None, True)]
    assert urls.filter_urls(caps.limit(0), entries).count() == 0
    assert all(r.kept for r in urls.filter_urls(caps, entries.limit(0)).collect())


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    item = [f"q{rng.randrange(500)}" for _ in range(30)]
    edited = item[:7] + ["new"] + item[8:20] + item[21:]
    far = [w if k % 3 else f"other{k}" for k, w in enumerate(item)]
    texts = {900: "x y " + " ".join(item).upper() + " z", 901: " ".join(["a"] * 50 + edited), 902: " ".join(far), 903: "only four words here", 904: " ".join(item[:29])}
    extra = spark.createDataFrame([(i, t, "en", "s", 1, 1, 1, 1) for i, t in texts.items()], SCHEMA)
    items = spark.createDataFrame([(1, " ".join(item), 0), (2, "four words here", 0), (3, None, 0), (4, "", 0), (5, " ".join(item), 0)], "item_id long, text string, doc_id long")
    got = {r.doc_id: r["items"] for r in decontaminate.contaminated(docs.unionByName(extra), items).where("contaminated").collect()}
    assert got == {900: [1, 5], 901: [1, 5], 903: [2], 904: [1, 5]}
    clash = docs.select("*", F.lit(1).alias("items"), F.lit(2).alias("contaminated"), F.lit(3).alias("c0"))
    assert decontaminate.clean(clash, items).columns == clash.columns and decontaminate.clean(clash, items).count() == docs.count()
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("n", [5, 8, 30, 100, 300])
def test_decontamination_recall_at_the_edit_limit(n):
    rng = random.Random(n)
    items = [(i, [rng.randrange(1 << 62) for _ in range(n)]) for i in range(100)]
    matcher = decontaminate.Matcher(items, 0.8)
    texts = []
    for t in range(200):
        w, edits = list(items[t // 2][1]), n // 5
        # evenly spaced edits leave the shortest runs; the others fall anywhere
        for at in sorted([(k + 1) * n // (edits + 1) for k in range(edits)] if t % 2 else rng.sample(range(n), edits), reverse=True):
            kind = rng.choice("sdi")
            w[at : at + (kind != "i")] = [] if kind == "d" else [rng.randrange(1 << 62)]
        texts.append([rng.randrange(1 << 62) for _ in range(20)] + w + [rng.randrange(1 << 62) for _ in range(20)])
    found = matcher.block(np.array([w for t in texts for w in t], np.uint64), np.cumsum([0, *map(len, texts)]))
    assert sum(t // 2 in found.get(t, ()) for t in range(200)) >= 0.95 * 200
    assert all(ids <= {t // 2} for t, ids in found.items())


def test_decontamination_against_all_stretches(spark):
    rng = random.Random(21)
    items = [(k, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 30)))) for k in range(12)]
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100 + i, " ".join([*rows[i][1].split(), *items[i % 12][1].split()[: None if i % 3 else -1]])) for i in range(40)]
    want = {}
    for i, t in rows:
        h = {w: k for k, w in enumerate(sorted({*t.split(), *(x for _, y in items for x in y.split())}))}
        text = np.array([h[w] for w in t.split()], np.int64)
        want[i] = [k for k, y in items if decontaminate.edit_distance_inside(np.array([h[w] for w in y.split()]), text) <= int(0.2 * len(y.split()) + 1e-9)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: r["items"] for r in decontaminate.contaminated(d, b).collect()} == want


def test_decontamination_in_blocks(spark):
    rng = random.Random(11)
    items = [(k, " ".join(f"q{rng.randrange(900)}" for _ in range(n))) for k, n in enumerate((20, 30, 25, 2100))]
    texts = [(9, items[0][1] + " x " + items[2][1]), (8, "y " + items[3][1]), (7, "nothing here"), (6, None)]
    d, i = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in ({}, {"max_items": 1}, {"max_words": 40}):
        got = {r.doc_id: (r["items"], r.contaminated) for r in decontaminate.contaminated(d, i, **most).collect()}
        assert got == {9: ([0, 2], True), 8: ([3], True), 7: ([], False), 6: ([], False)}


@pytest.mark.parametrize("hot", [4000, 1])
def test_suffix_dedup(docs, rows, empty, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    length = 40
    raws = {i: (t or "").encode() for i, t in rows.items()}
    c = Counter(r[k : k + length] for r in raws.values() for k in range(len(r) - length + 1))
    for r in suffix_dedup.remove_repeats(docs, length).collect():
        raw = raws[r.doc_id]
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if c[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_repeated_rows(spark):
    text = "".join(random.Random(8).choices("abcd", k=500))
    d = spark.createDataFrame([(1, text)] * 60 + [(None, text)] * 3 + [(2, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(d).collect())
    assert got == {(1, 500, 500, 1): 60, (None, 500, 500, 1): 3, (2, 0, 0, 0): 1}


def test_shares_fill_siblings_first():
    supply = {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 1000}
    assert mixing.budgets(supply, {}, 100, 1) == {("a", "x"): 10, ("a", "y"): 40, ("b", "x"): 50}
    assert mixing.budgets(supply, {}, 600, 1) == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 490}
    assert mixing.budgets(supply, {}, 10**6, 2) == {k: 2 * n for k, n in supply.items()}


def test_mixing(docs, rows, empty):
    out = mixing.mix(docs, {"language": "lang", "source": "source"}, {("en",): 3.0}, share=0.7, epochs=3, range_rows=2)
    assert out.columns[: len(docs.columns)] == docs.columns
    taken = out.select("doc_id", "mix_path", "mix_tokens", "mix_epoch").collect()
    supply, got = Counter(), Counter()
    for r in docs.collect():
        supply[(r.lang or "", r.source)] += len(lower(r.text))
    for r in taken:
        assert r.mix_tokens == len(lower(rows[r.doc_id]))
        got[tuple(r.mix_path)] += r.mix_tokens
    want = mixing.budgets(supply, {("en",): 3.0}, int(0.7 * sum(supply.values())), 3)
    largest = max(len(lower(t)) for t in rows.values())
    assert all(got[p] <= want[p] and got[p] > want[p] - largest - 1 for p in want)
    assert mixing.mix(empty, {"l": "lang"}, {}).count() == 0
    # which documents: whole epochs, then the longest prefix in the order of the seeded key
    keys = {(r.doc_id, w): r[f"k{w}"] for r in docs.select("doc_id", *(F.xxhash64("doc_id", F.lit(w).cast("long"), F.lit(17)).alias(f"k{w}") for w in range(4))).collect() for w in range(4)}
    lengths = {(r.lang or "", r.source): [] for r in docs.collect()}
    for r in docs.collect():
        lengths[r.lang or "", r.source].append((r.doc_id, len(lower(r.text))))
    expected = Counter()
    for p, b in want.items():
        whole, rest = divmod(b, supply[p])
        for e in range(whole):
            expected.update((i, e) for i, _ in lengths[p])
        for i, n in sorted(lengths[p], key=lambda x: keys[x[0], whole]):
            rest -= n
            if rest < 0:
                break
            expected[i, whole] += 1
    assert Counter((r.doc_id, r.mix_epoch) for r in taken) == expected
    clash = docs.withColumn("mix_path", F.lit("own")).withColumn("c0", F.lit(5))
    out = mixing.mix(clash, {"language": "lang"}, {}, share=0.5)
    assert out.columns == [*clash.columns, "mix_path_", "mix_tokens", "mix_epoch"] and {(r.mix_path, r.c0) for r in out.collect()} == {("own", 5)}


def test_private(spark, empty):
    def luhn(x):
        return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(x))) % 10 == 0

    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def brute(t):
        out = []
        for kind, p in patterns:
            for m in re.finditer(p, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                    out.append(f"{kind}:{m.start()}:{m.end()}")
        return ",".join(out)

    texts = [None, "", "a@b.c%d@e.f x@y.z", "1.2.3.4.5.6.7.8 300.1.1.1 01.02.03.004", "4111 1111 1111 1111 x 4111-1111-1111-1112", "+1 (988) 555-2485 +12345678 ++1 2 3 4 5 6 7 8 9 0", "é😀 q.w@e-r.t.y- 4111111111111111-", "a" * 50_000 + "@" + ".".join(["bbb"] * 3000), "9" * 30_000]
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in privacy.find_private(plain).select("doc_id", privacy.span_list(list(privacy.KINDS)).alias("s")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    # a word that stands by one address, in different contexts, discloses it
    rows = [(i, f"word{chr(97 + i) * 4} Zanzibar me@here.org other{chr(97 + i) * 4}") for i in range(5)] + [(100 + i, f"nothing special {chr(97 + i % 26) * 5}") for i in range(400)]
    found = privacy.find_private(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.selectExpr("sum(size(s_term)) n").first().n == 5
    assert privacy.sanitise(found).where("doc_id = 0").first().text == "wordaaaa [TERM] [EMAIL] otheraaaa"
    assert privacy.find_private(empty).count() == 0


def other_documents(n):
    return [(10_000 + i, f"nothing special {chr(97 + i % 26) * 5}") for i in range(n)]


def test_private_terms_of_copied_documents(spark):
    rows = [(i, f"{c * 4} Zanzibar me@here.org {c * 5}") for i, c in enumerate("abc")]
    rows += [(100 + i, rows[0][1]) for i in range(50)]
    found = privacy.find_private(spark.createDataFrame(rows + other_documents(6000), "doc_id long, text string"))
    got = {r.doc_id: r.n for r in found.selectExpr("doc_id", "size(s_term) n").where("doc_id < 10000").collect()}
    assert set(got) == {i for i, _ in rows} and all(got.values())


def test_private_terms_of_null_and_repeated_ids(spark):
    rows = [(None if i < 3 else 7, f"word{chr(97 + i) * 4} Zanzibar me@here.org other{chr(97 + i) * 4}") for i in range(5)] + [(7, "nothing")]
    found = privacy.find_private(spark.createDataFrame(rows + other_documents(400), "doc_id long, text string"))
    got = sorted(((r.doc_id or 0), len(r.s_term)) for r in found.where("doc_id is null or doc_id < 10000").collect())
    assert got == [(0, 1), (0, 1), (0, 1), (7, 0), (7, 1), (7, 1)]


def test_private_terms_far_from_the_entity(spark):
    fill = "".join(" " + "x" * (1 + k % 9) for k in range(60))
    rows = [(i, f"Zanzibar and Ned{fill} {c * 4} me@here.org") for i, c in enumerate("abcde")]
    fillers = [(20_000 + i, fill) for i in range(20)]
    found = privacy.find_private(spark.createDataFrame(rows + fillers + other_documents(800), "doc_id long, text string"))
    got = {r.doc_id: [s.value for s in r.s_term] for r in found.where("doc_id < 10000").collect()}
    assert all({"Zanzibar", "Ned"} <= set(v) and not any("x" in w for w in v) for v in got.values()) and len(got) == 5


def test_quality_rules(docs, rows, empty):
    for r in quality_rules.quality_rules(docs).collect():
        t = rows[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(cover))
        lines, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.add(line)
        assert r.n_dup_lines == dup
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.kept and r.base_failed)
        far = len(w) >= 50 and (r.class_distance > 0.30 or r.word_distance > 0.55)
        assert r.kept == (not r.base_failed and not far)
    assert quality_rules.quality_rules(empty).count() == 0


def test_distances_against_the_language_reference(docs, rows):
    """Both distances recomputed from the texts."""
    table = quality_rules._class_table()
    common = {w.encode(): i for i, w in enumerate(quality_rules.WORDS)}
    made = {i: quality_rules.figures(t, table, common, {}) for i, t in rows.items()}
    lang = {r.doc_id: r.lang or "" for r in docs.collect()}
    refs = {}
    for i, f in made.items():
        if f[0] >= 50:
            c, w = refs.setdefault(lang[i], [np.zeros(len(f[5])), np.zeros(len(f[6]))])
            refs[lang[i]] = [c + f[5], w + f[6]]

    def distance(p, q):
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))

    for r in quality_rules.quality_rules(docs).where("n_words >= 50").collect():
        c, w = refs[lang[r.doc_id]]
        assert r.class_distance == pytest.approx(distance(made[r.doc_id][5], c), abs=1e-9)
        assert r.word_distance == pytest.approx(distance(made[r.doc_id][6], w), abs=1e-9)


def test_distance_is_bounded(spark):
    q = quality_rules._js("array(1L, 0L)", "array(0L, 1L)"), quality_rules._js("array(2L, 2L)", "array(1L, 1L)"), quality_rules._js("array(0L, 0L)", "array(1L, 1L)")
    a, b, c = spark.sql(f"select {q[0]} a, {q[1]} b, {q[2]} c").first()
    assert a == pytest.approx(1) and b == pytest.approx(0) and c == 0


def test_many_private_values_in_one_text(spark):
    """Spans and what lies outside them come in one pass over a long row."""
    n = 40_000
    text = "".join(f"write to u{i}@host.example or " for i in range(n))
    d = spark.createDataFrame([(1, text), (2, "no data"), (None, None)], "doc_id long, text string")
    found = privacy.find_private(d)
    r = found.where("doc_id = 1").select(F.size("s_email").alias("n"), F.element_at("s_email", -1)["stop"].alias("last")).head()
    assert (r.n, r.last) == (n, len(text) - len(" or "))
    clean = {r.doc_id: r.text for r in privacy.sanitise(found).collect()}
    assert clean == {1: "write to [EMAIL] or " * n, 2: "no data", None: ""}


def test_blocks_of_other_rows_have_other_keys():
    """Texts that run into each other, ids that do, and the same of both."""
    cases = [([None, None], [b"ab c", b"d e f"]), ([None, None], [b"ab cd", b" e f"]), ([1, 2], [b"ab c", b"d e f"]), ([2, 1], [b"ab c", b"d e f"]), ([1], [b"ab cd e f"])]
    assert len({pitman_yor.block_key(*c) for c in cases}) == len(cases) and pitman_yor.block_key(*cases[0]) == pitman_yor.block_key(*cases[0])


def test_scores_of_null_and_repeated_ids(spark):
    """Blocks whose texts only joined are equal: every row has its own counts; no table is left behind."""
    before = spark.sql("show tables").count()
    rows = [(None, "ab c"), (None, "d e f"), (None, "ab cd"), (None, " e f"), (7, "x y"), (7, "x"), (7, " y"), (7, "x y"), (9, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(5, "text")
    got = sorted((r.doc_id, r.n_tokens) for r in pitman_yor.score(d).where("doc_id is not null").collect())
    assert got == sorted((i, len((t or "").split()) + 1) for i, t in rows if i is not None)
    # two partitions whose joined texts agree
    a = spark.createDataFrame(rows[:2], "doc_id long, text string").coalesce(1).union(spark.createDataFrame(rows[2:4], "doc_id long, text string").coalesce(1))
    assert sorted(r.n_tokens for r in pitman_yor.score(a).collect()) == [3, 3, 3, 4]
    assert spark.sql("show tables").count() == before


REPEATED = [(None, "one two three four five six seven eight nine ten " * 6), (3, "alpha beta. " * 30), (3, "alpha beta. " * 30), (3, "x"), (None, None), (None, "x"), (5, ""), (5, None), (7, "gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron")]


@pytest.fixture(scope="module")
def repeated(spark):
    return spark.createDataFrame([(i, t, "en", "s", None, 1) for i, t in REPEATED], "doc_id long, text string, lang string, source string, n_chars long, start long").repartition(4)


def test_token_files_of_repeated_and_null_ids(spark, repeated):
    """Every row is a document of its own; starts follow each other without a gap."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [(i, [*lib.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in REPEATED]
    got = sorted(tokens.token_files(spark, repeated).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids), key=str)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)


def test_decontamination_of_repeated_and_null_ids(spark, repeated):
    items = spark.createDataFrame([(1, REPEATED[-1][1]), (1, REPEATED[-1][1]), (None, None), (2, "")], "item_id long, text string")
    got = sorted(((r.doc_id, r.contaminated) for r in decontaminate.contaminated(repeated, items).collect()), key=str)
    assert got == sorted(((i, i == 7) for i, _ in REPEATED), key=str)
    assert decontaminate.clean(repeated, items).count() == len(REPEATED) - 1


def test_mixing_of_repeated_and_null_ids(spark, repeated):
    """With the whole supply as its budget every row is taken once, whatever its id."""
    got = mixing.mix(repeated, {"language": "lang"}, {("en",): 1.0}, share=1.0, epochs=1)
    assert sorted(((r.doc_id, r.text, r.mix_epoch) for r in got.collect()), key=str) == sorted(((i, t, 0) for i, t in REPEATED), key=str)


def test_quality_rules_of_repeated_and_null_ids(repeated):
    got = quality_rules.quality_rules(repeated).collect()
    assert sorted(((r.doc_id, r.n_words) for r in got), key=str) == sorted(((i, len((t or "").split())) for i, t in REPEATED), key=str)
    assert all(r.base_failed for r in got if r.n_words < 10)
