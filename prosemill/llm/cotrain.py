"""Quality classifier by co-training two views of a document.

The text view sees words; the metadata view sees language, source, length and
layout (lines, marks, case, repetition). Each starts from the labelled sample.
In every round both views score all documents without a label in the sample;
each labels those it is surest of, a further per_round of all of them for each
label and round, and hands them to the other. What they are handed enters the
fits as sums over all of them: the text view's words weigh by their log-ratio in
the labelled and the handed documents (with a correction fitted on the labelled
ones), and the metadata view takes Newton steps on both. Platt scaling
calibrates each view on labelled documents kept out of training, and a small
logistic model over the calibrated views (their log-odds and the lesser of the
two) scores every document.

A document is good if labels.quality is 1 and labels.toxic is not 1. The labelled
sample is bounded by max_labelled rows, chosen by a hash of the id; all else
covers all documents. Features are written once to the shared folder; a round is
a few passes over them, whose results are DIM numbers at most.

Defined results: null text is empty; null language, source or length have values
of their own; labels with nulls are ignored, and of repeated labels the worst
counts; of rows with one id one is in the labelled sample (that with the least
features); equally sure documents are labelled together; with a single class (or
no labels) every document scores 0.5 and is kept; repeated rows are scored one by
one; extra columns are ignored, or kept by good_documents() whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, saved, word_hashes

DIM = 1 << 18
SLOTS = 32  # hashed one-hot slots for language and source each
SHAPE = 17
WIDTH = SHAPE + 2 * SLOTS


def features(text: str | None, lang: str | None, source: str | None, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words, and the metadata vector."""
    import xxhash

    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    h = word_hashes(words, cache) if words else np.zeros(0, np.uint64)
    distinct = np.unique(h)
    # the text view sees words without case and edge punctuation
    bare = {w.strip(b".,;:!?\"'()[]{}*%&$#|<>-") for w in set(raw.lower().split())}
    idx = np.unique((word_hashes(list(bare), cache) >> np.uint64(20)) & np.uint64(DIM - 1)).astype("<u4")
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256)
    n, nw = max(1, len(raw)), max(1, len(words))
    lines = b[10] + 1
    upper, digit, letter = b[65:91].sum(), b[48:58].sum(), b[65:91].sum() + b[97:123].sum() + b[128:].sum()
    marks = b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum()
    repeats = float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0
    dense = np.zeros(WIDTH, "<f4")
    dense[:SHAPE] = (
        1, np.log1p(n) / 10, np.log1p(nw) / 8, np.log1p(lines) / 5, np.log1p(n / lines) / 8, len(raw) / nw / 10,
        4 * upper / n, 4 * digit / n, letter / n, 4 * marks / n, 10 * (b[33] + b[63]) / n, 10 * b[124] / n,
        10 * (b[35] + b[36] + b[37] + b[38] + b[42] + b[60] + b[62]) / n, len(distinct) / nw, repeats, nw < 10, 10 * (b[44] + b[46]) / n,
    )
    dense[SHAPE + xxhash.xxh32_intdigest(lang or "\0") % SLOTS] = 1
    dense[SHAPE + SLOTS + xxhash.xxh32_intdigest(source or "\0") % SLOTS] = 0.3
    return idx, dense


class Sparse:
    """Rows of slot numbers, as one array with offsets."""

    def __init__(self, rows: list[np.ndarray]):
        self.idx = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.n = np.array([len(r) for r in rows], np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.n)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.idx], minlength=len(self.n))

    def back(self, e: np.ndarray, dim: int) -> np.ndarray:
        return np.bincount(self.idx, e[self.row], minlength=dim)


def _sig(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(dot, back, dim: int, y: np.ndarray, weight: np.ndarray, l2: float, steps: int, start=None, rate: float = 0.1):
    """Logistic regression by full-batch Adam; (weights, bias)."""
    w, b = (np.zeros(dim), 0.0) if start is None else (start[0].copy(), start[1])
    m, v, mb, vb = np.zeros(dim), np.zeros(dim), 0.0, 0.0
    total = weight.sum()
    for t in range(1, steps + 1):
        e = (_sig(dot(w) + b) - y) * weight / total
        g, gb = back(e) + l2 * w, e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return w, b


class Rows:
    """Features of an Arrow batch: slots of all rows with their offsets, and the dense matrix."""

    def __init__(self, idx: pa.BinaryArray, dense: pa.BinaryArray):
        self.n = len(idx)
        size = pa.compute.binary_length(idx).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        self.idx = np.frombuffer(b"".join(idx.to_pylist()), "<u4").astype(np.int64)
        self.row = np.repeat(np.arange(self.n), size)
        self.dense = np.frombuffer(b"".join(dense.to_pylist()), "<f4").reshape(self.n, WIDTH).astype(float)

    def scores(self, model: dict) -> np.ndarray:
        """Log-odds of the two views."""
        text = np.bincount(self.row, model["text"][0][self.idx], self.n) + model["text"][1]
        return np.stack([text, self.dense @ model["meta"][0] + model["meta"][1]])


#: Log-odds above the surest needed are counted in steps of 1 / STEPS, LAST of them.
STEPS, LAST = 50, 2000


def degrees(z: np.ndarray, sure: float) -> np.ndarray:
    """How sure each view is of each label, [view, label, row] in whole steps, -1 for not enough.

    A document that one view alone can fault stays out: good labels go only where the other view agrees.
    """
    least = np.log(sure / (1 - sure))
    out = np.full((2, 2, z.shape[1]), -1)
    for view in (0, 1):
        for label, x in ((0, -z[view]), (1, z[view])):
            ok = (x >= least) & ((label == 0) | (z[1 - view] >= 0))
            out[view, label, ok] = np.minimum((x[ok] - least) * STEPS, LAST - 1)
    return out


def quotas(counts: np.ndarray, most: int) -> np.ndarray:
    """The least degree taken of each view and label: as many of the surest as fit in most, at least those of the highest degree."""
    out = np.full((2, 2), LAST)
    for view in (0, 1):
        for label in (0, 1):
            above = np.cumsum(counts[view, label, ::-1])[::-1]
            some = np.flatnonzero(above)
            if len(some):
                out[view, label] = min(int(some[-1]), int(np.flatnonzero(np.append(above, 0) <= most)[0]))
    return out


class Labelled:
    """The labelled sample, cut into documents to train on and documents to calibrate on."""

    def __init__(self, rows: list[tuple]):
        self.idx = [np.frombuffer(r[0], "<u4") for r in rows]
        self.dense = np.stack([np.frombuffer(r[1], "<f4") for r in rows]).astype(float) if rows else np.zeros((0, WIDTH))
        self.y = y = np.array([r[2] for r in rows], int)
        self.usable = len(set(y)) == 2
        every = np.arange(len(y))
        self.hold = every[::4] if len(set(y[::4])) == 2 else every
        rest = np.setdiff1d(every, self.hold)
        self.first = rest if len(set(y[rest])) == 2 else every
        self.counts = np.stack([np.bincount(Sparse([self.idx[i] for i in self.first if y[i] == k]).idx, minlength=DIM) for k in (0, 1)])
        self.sizes = np.array([(y[self.first] == k).sum() for k in (0, 1)])

    def text_view(self, counts: np.ndarray, sizes: np.ndarray, share: float, start: np.ndarray | None) -> tuple[np.ndarray, float, np.ndarray]:
        """Weights of the words and the bias: a correction of each word's log-ratio, fitted on the labelled documents.

        counts, sizes: documents by label (and word) handed over by the other view, which weigh share each.
        """
        both, n = self.counts + share * counts, self.sizes + share * sizes
        seen = self.counts.sum(axis=0) + counts.sum(axis=0) >= min(5, max(1, int(self.sizes.sum()) // 50))
        ratio = np.where(seen, np.log((both[1] + 0.5) / (n[1] + 1)) - np.log((both[0] + 0.5) / (n[0] + 1)), 0.0)
        x = Sparse([self.idx[i] for i in self.first])
        y, size = self.y[self.first].astype(float), np.abs(ratio)
        # a common factor of the ratios, then a correction for each word
        naive = x.dot(ratio)[:, None] / 100
        a, bias = fit(naive.__matmul__, naive.T.__matmul__, 1, y, np.ones(len(y)), 1e-6, 200)
        fixed = naive @ a
        w, bias = fit(lambda w: x.dot(w * size) + fixed, lambda e: x.back(e, DIM) * size, DIM, y, np.ones(len(y)), 1e-5, 150 if start is None else 60, (np.zeros(DIM) if start is None else start, bias))
        return ratio * a[0] / 100 + w * size, bias, w

    def calibrated(self, model: dict) -> dict:
        """model with Platt scaling of each view and the weights of the stack, from the documents held back."""
        x = Sparse([self.idx[i] for i in self.hold])
        y = self.y[self.hold].astype(float)
        logits = np.stack([x.dot(model["text"][0]) + model["text"][1], self.dense[self.hold] @ model["meta"][0] + model["meta"][1]], axis=1)
        platt = []
        for view in (0, 1):
            z = np.clip(logits[:, view : view + 1], -30, 30) / 4
            platt.append(fit(z.__matmul__, z.T.__matmul__, 1, y, np.ones(len(y)), 1e-4, 300, (np.array([2.0]), 0.0)))
        c = np.stack([np.clip(logits[:, v], -30, 30) / 4 * platt[v][0][0] + platt[v][1] for v in (0, 1)], axis=1)
        z = np.column_stack([c, c.min(axis=1)]) / 4
        mix = fit(z.__matmul__, z.T.__matmul__, 3, y, np.ones(len(y)), 1e-4, 500, (np.array([1.0, 1.0, 2.0]), 0.0))
        return model | {"platt": [(float(w[0]), float(b)) for w, b in platt], "mix": mix}


def newton_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the weighted log-loss, one flat array; x has a last column of ones."""
    p = _sig(x @ w)
    return np.concatenate([x.T @ ((p - y) * weight), (x.T @ (x * (p * (1 - p) * weight)[:, None])).reshape(-1)])


def newton_step(sums: np.ndarray, w: np.ndarray, total: float, l2: float = 1e-4) -> np.ndarray:
    m = len(w)
    step = np.linalg.solve(sums[m:].reshape(m, m) / total + l2 * np.eye(m), sums[:m] / total + l2 * w)
    return w - step * min(1.0, 5 / max(1e-12, np.abs(step).max()))


def cotrain(spark, features: DataFrame, labelled: Labelled, rounds: int, per_round: float, sure: float, steps: int, weight: float) -> dict:
    """The two views' models; features: idx, dense and y (null where no label is used)."""
    pool = features.where("y is null").select("idx", "dense")
    n_pool = pool.count()

    def summed(of, size: int) -> np.ndarray:
        """The sum over the pool of a function from Rows to (places, numbers)."""

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                for a in range(0, batch.num_rows, 2048):
                    part = batch.slice(a, 2048)
                    total += of(Rows(part.column(0), part.column(1)))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "x"])

        got = pool.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
        out = np.zeros(size)
        out[got["at"].to_numpy(np.int64)] = got["x"].to_numpy(float)
        return out

    w, bias, start = labelled.text_view(np.zeros((2, DIM)), np.zeros(2), 0.0, None)
    ones = np.ones((len(labelled.first), 1))
    x, y = np.hstack([labelled.dense[labelled.first], ones]), labelled.y[labelled.first].astype(float)
    meta = np.zeros(WIDTH + 1)
    for _ in range(12):
        meta = newton_step(newton_sums(x, y, np.ones(len(y)), meta), meta, len(y))
    model = {"text": (w, bias), "meta": (meta[:-1], meta[-1])}
    for turn in range(1, rounds + 1 if n_pool else 1):
        shared = spark.sparkContext.broadcast(model)

        def counted(rows: Rows, shared=shared) -> np.ndarray:
            d = degrees(rows.scores(shared.value), sure)
            cell = np.arange(4).reshape(2, 2, 1) * LAST + d
            return np.bincount(cell[d >= 0], minlength=4 * LAST).astype(float)

        counts = summed(counted, 4 * LAST).reshape(2, 2, LAST)
        most = max(1, int(turn * per_round * n_pool))
        least = quotas(counts, most)
        handed = np.array([[counts[v, k, least[v, k] :].sum() for k in (0, 1)] for v in (0, 1)])
        # what a view is handed weighs a part of its labelled documents at most
        share = [min(0.5, weight * len(labelled.first) / max(1.0, handed[v].sum())) for v in (0, 1)]

        def words(rows: Rows, shared=shared, least=least) -> np.ndarray:
            d = degrees(rows.scores(shared.value), sure)[1]
            return np.concatenate([np.bincount(rows.idx[(d[k] >= least[1, k])[rows.row]], minlength=DIM) for k in (0, 1)]).astype(float)

        seen = summed(words, 2 * DIM).reshape(2, DIM)
        w, bias, start = labelled.text_view(seen, handed[1], share[1], start)
        for _ in range(steps):

            def sums(rows: Rows, shared=shared, least=least, meta=meta, share=share) -> np.ndarray:
                d = degrees(rows.scores(shared.value), sure)[0]
                use = (d[0] >= least[0, 0]) | (d[1] >= least[0, 1])
                x = np.hstack([rows.dense[use], np.ones((int(use.sum()), 1))])
                return newton_sums(x, (d[1][use] >= least[0, 1]).astype(float), np.full(len(x), share[0]), meta)

            every = summed(sums, (WIDTH + 1) * (WIDTH + 2)) + newton_sums(x, y, np.ones(len(y)), meta)
            meta = newton_step(every, meta, len(y) + share[0] * handed[0].sum())
        model = {"text": (w, bias), "meta": (meta[:-1], meta[-1])}
    return labelled.calibrated(model)


def _fitted(docs: DataFrame, labels: DataFrame, max_labelled: int, rounds: int, per_round: float, sure: float, steps: int, weight: float, id_col: str):
    """(features of every row of docs as a table of id, idx, dense and y, the model as a broadcast)."""
    spark = docs.sparkSession
    truth = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.expr("cast(min(quality) = 1 and max(toxic) <> 1 as int)").alias("y"))
    hashed = F.expr("(xxhash64(doc_id) & 1048575) / 1048576D")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    known = truth.join(ids, "doc_id")
    sample = known.where(hashed < 0.97 * max_labelled / max(1, known.count())).limit(max_labelled)
    picked = F.broadcast(sample.select(F.col("doc_id").alias("id"), "y"))  # at most max_labelled short rows
    seen = docs.select(F.col(id_col).cast("long").alias("id"), *_seen())

    def extract(batches):
        cache = held("words", dict)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), *_extracted(part.columns[1:], cache)], ["id", "idx", "dense"])

    rows = saved(seen.mapInArrow(extract, "id long, idx binary, dense binary").join(picked, "id", "left"), "classifier-features")
    chosen = rows.where("y is not null").groupBy("id").agg(F.min(F.struct("idx", "dense", "y")).alias("r")).select("id", "r.*")
    labelled = Labelled([(bytes(r.idx), bytes(r.dense), r.y) for r in sorted(chosen.collect())])  # at most max_labelled rows
    model = cotrain(spark, rows, labelled, rounds, per_round, sure, steps, weight) if labelled.usable else None
    return rows, spark.sparkContext.broadcast(model)


def _seen() -> list:
    """What the views see of a document."""
    return [F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")]


def _extracted(columns, cache: dict) -> list[pa.Array]:
    """idx and dense of texts, languages and sources."""
    f = [features(*row, cache) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
    return [pa.array([i.tobytes() for i, _ in f], pa.binary()), pa.array([d.tobytes() for _, d in f], pa.binary())]


def _scores(got: dict | None, idx: pa.Array, dense: pa.Array) -> np.ndarray:
    """The two views' scores and the score of all, a row each."""
    out = np.full((3, len(idx)), 0.5)
    if got:
        zs = Rows(idx, dense).scores(got)
        c = np.stack([np.clip(zs[v], -30, 30) / 4 * got["platt"][v][0] + got["platt"][v][1] for v in (0, 1)])
        out[0], out[1] = _sig(c[0]), _sig(c[1])
        out[2] = _sig(np.stack([c[0], c[1], c.min(axis=0)], axis=1) / 4 @ got["mix"][0] + got["mix"][1])
    return out


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = 10_000, rounds: int = 3, per_round: float = 0.05, sure: float = 0.95, steps: int = 3, weight: float = 0.25, id_col: str = "doc_id") -> DataFrame:
    """doc_id, text_score, meta_score, score and kept."""
    rows, shared = _fitted(docs, labels, max_labelled, rounds, per_round, sure, steps, weight, id_col)

    def score(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                out = _scores(shared.value, part.column(1), part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v) for v in out), pa.array(out[2] >= threshold)], ["id", "text_score", "meta_score", "score", "kept"])

    scored = rows.select("id", "idx", "dense").mapInArrow(score, "id long, text_score double, meta_score double, score double, kept boolean")
    return scored.select(F.col("id").alias(id_col), "text_score", "meta_score", "score", "kept")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = 10_000, rounds: int = 3, per_round: float = 0.05, sure: float = 0.95, steps: int = 3, weight: float = 0.25, id_col: str = "doc_id") -> DataFrame:
    """The documents that the classifier keeps, with their own columns.

    A score depends on text, language and source alone, so it is made anew beside the document: to meet the scores made
    of the features, all texts would have to be shuffled.
    """
    _, shared = _fitted(docs, labels, max_labelled, rounds, per_round, sure, steps, weight, id_col)

    def kept(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cache = held("words", dict)
        for columns in batches:
            parts = range(0, max(1, len(columns[0])), 512)
            yield pa.concat_arrays([pa.array(_scores(shared.value, *_extracted([c.slice(a, 512) for c in columns], cache))[2] >= threshold) for a in parts])

    return docs.where(F.arrow_udf(kept, "boolean")(*_seen()))
