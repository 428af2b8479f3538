"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants. Every token is a customer of the restaurant of its context, the
preceding token: one restaurant for each distinct preceding token, known by 40
bits of its hash (words are known by 64). All context restaurants share one parent, the word restaurant,
whose base is uniform over the training vocabulary and one unknown word.
Discounts come from the counts of counts.

Gibbs. A sweep reseats the customers of every (context, word) given the tables
of everything else, then those of the parent, as a Chinese restaurant: a
customer opens a table with probability in proportion to
(strength + discount * tables) * P_parent(word), else joins one in proportion to
customers - discount * tables. Past the first customers of a dish the seating
goes in blocks of a sixteenth. Predictive probabilities are averaged over the
samples.

Plan. Tokens travel once, packed by word partition: a word's counts in all
contexts and its parent counts meet in one task. The sums by context that it
needs of the others come back by key: each word partition sends its own sums to
the partitions of the contexts, which add them up and answer in the order of the
list they were first sent. The token table is bucketed, so these joins leave it
where it is. Words with more than 1/HOT_SHARE of a sample's tokens (so at most
HOT_SHARE of them) are hot: their tokens go by context instead, the counts of hot
words in hot contexts are summed for the driver and never travel, and the sums of
hot words and hot contexts go through the driver. Sampling the hot words changes
where they are counted, not what is counted. Sweeps are seeded and repeat their
predecessors', so the state between jobs is only the sums.

Defined results: null and empty texts have one token, the end; documents with
crc32(id) mod 7 = held_out_fold are scored only; without training tokens every
token has the base's probability 1; repeated rows are documents of their own;
a null id is "" for the fold; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Hasher, held, partitions, saved, scratch

HOT_SHARE = 1024
CONTEXTS = HOT_SHARE  # the most hot contexts; there is no limit on all contexts
END = 0x5D4C3B2A19080706
CTX = np.uint64((1 << 40) - 1)
#: Words frequent in a sample travel as two bytes, RARE stands for a hash that follows; this changes the size alone.
RARE = 0xFFFF
#: Sums for a document travel as whole multiples of 2 ** -FINE.
FINE = 26
#: A text's number in its block takes 15 bits; the last says that the text is held out.
HELD = np.uint16(1 << 15)


def tokens_of(raws: list[bytes], hasher: Hasher):
    """(token hashes, hashes of the tokens before, document number) of the texts, each with its end token."""
    h, first = hasher.words(raws)
    n = np.diff(first) + 1
    ends = np.cumsum(n) - 1
    tok = np.empty(len(h) + len(raws), np.uint64)
    is_end = np.zeros(len(tok), bool)
    is_end[ends] = True
    tok[~is_end], tok[is_end] = h, np.uint64(END)
    before = np.concatenate([[np.uint64(END)], tok[:-1]])
    return tok, before, np.repeat(np.arange(len(raws), dtype=np.uint16), n)


def seat(count: np.ndarray, weight: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of dishes with count customers, weight = (strength + discount * tables) * P_parent."""
    order = np.argsort(-count, kind="stable")
    c, a = count[order], weight[order]
    t = (c > 0).astype(float)
    n, most = 1, int(c[0]) if len(c) else 0
    while n < most:
        k = int(np.searchsorted(-c, -n, "left"))  # dishes with more than n customers
        step = max(1, n // 16) if n >= 64 else 1
        p = a[:k] / (a[:k] + np.maximum(n - discount * t[:k], 1e-9))
        t[:k] += (rng.random(k) < p) if step == 1 else rng.binomial(np.minimum(step, c[:k] - n).astype(np.int64), p)
        n += step
    out = np.empty_like(t)
    out[order] = t
    return out


def among(hot: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x would be in the sorted hot hashes, and whether it is there."""
    if not len(hot):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(hot, x), len(hot) - 1)
    return at, hot[at] == x


class Cells:
    """The counts of one word partition: cells (word, context) with their training counts.

    shared has the hot number of each word, -1 for words that have all their cells here. Vectors of sums:
    tables by context, then customers and tables of the n_hot hot words in the parent, then those of the parent.
    """

    def __init__(self, word: np.ndarray, ctx: np.ndarray, count: np.ndarray, n_words: int, seed: int, n_ctx: int | None = None, shared: np.ndarray | None = None, n_hot: int = 0):
        self.word, self.ctx, self.count, self.n_words, self.seed, self.n_hot = word, ctx, count, n_words, seed, n_hot
        self.n_ctx = int(ctx.max()) + 1 if n_ctx is None else n_ctx
        shared = np.full(n_words, -1) if shared is None else shared
        self.own, self.hot_words = shared < 0, np.flatnonzero(shared >= 0)
        self.hot = shared[self.hot_words]
        self.word_count = np.bincount(word, count, n_words)

    def sums(self, t: np.ndarray, tw: np.ndarray) -> np.ndarray:
        """What these cells add to the sums; the tables of hot words are not theirs to know."""
        cw = np.bincount(self.word, t, self.n_words)
        return np.concatenate([np.bincount(self.ctx, t, self.n_ctx), np.bincount(self.hot, cw[self.hot_words], self.n_hot), np.zeros(self.n_hot), [t.sum(), tw[self.own].sum()]])

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        t = (self.count > 0).astype(float)
        return t, (np.bincount(self.word, t, self.n_words) > 0).astype(float)

    def counts(self) -> np.ndarray:
        """Cells of one and two customers, own words of one and two tables, own words and customers."""
        t, _ = self.first()
        cw = np.bincount(self.word, t, self.n_words)[self.own]
        return np.array([(self.count == 1).sum(), (self.count == 2).sum(), (cw == 1).sum(), (cw == 2).sum(), (self.word_count[self.own] > 0).sum(), self.count.sum()], float)

    def stats(self) -> np.ndarray:
        return np.concatenate([np.bincount(self.ctx, self.count, self.n_ctx), self.sums(*self.first()), self.counts()])

    def parent(self, g: dict, t: np.ndarray, tw: np.ndarray, sums: np.ndarray) -> np.ndarray:
        cw, tw = np.bincount(self.word, t, self.n_words), tw.copy()
        cw[self.hot_words], tw[self.hot_words] = (sums[self.n_ctx + k * self.n_hot :][self.hot] for k in (0, 1))
        return (np.maximum(cw - g["d0"] * tw, 0) + (g["s0"] + g["d0"] * sums[-1]) * g["base"]) / (g["s0"] + sums[-2])

    def sweep(self, g: dict, t: np.ndarray, tw: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([self.seed & 0x7FFFFFFF, k])
        p0 = self.parent(g, t, tw, sums)
        t = seat(self.count, (g["s"] + g["d"] * sums[self.ctx]) * p0[self.word], g["d"], rng)
        cw = np.bincount(self.word, t, self.n_words)
        return t, seat(cw, np.full(len(cw), (g["s0"] + g["d0"] * sums[-1]) * g["base"]), g["d0"], rng)

    def samples(self, g: dict, history: list[np.ndarray]):
        """The seatings after sweeps 1 .. len(history); history[k]: the sums that sweep k + 1 sees."""
        t, tw = self.first()
        for k, sums in enumerate(history):
            t, tw = self.sweep(g, t, tw, sums, k)
            yield t, tw

    def log_probability(self, g: dict, history: list[np.ndarray]) -> np.ndarray:
        """log10 of the averaged predictive probability of each cell; history has the sums after each sample as well."""
        if not g["n"]:
            return np.zeros(len(self.count))
        total = np.zeros(len(self.count))
        n = len(history) - 1
        for (t, tw), sums in zip(self.samples(g, history[:-1]), history[1:], strict=True):
            p0 = self.parent(g, t, tw, sums)
            total += (np.maximum(self.count - g["d"] * t, 0) + (g["s"] + g["d"] * sums[self.ctx]) * p0[self.word]) / (g["s"] + g["customers"][self.ctx])
        return np.log10(total / n)


def _constants(stats: np.ndarray, strength: float, parent_strength: float, n_hot: int = 0) -> tuple[dict, np.ndarray]:
    n_ctx = (len(stats) - 8 - 2 * n_hot) // 2
    customers, sums = stats[:n_ctx], stats[n_ctx:-6]
    n1, n2, m1, m2, v, n = stats[-6:]
    of = lambda a, b: float(np.clip(a / (a + 2 * b), 0.1, 0.95)) if a + b else 0.5
    return {"customers": customers, "d": of(n1, n2), "d0": of(m1, m2), "s": strength, "s0": parent_strength, "base": 1 / (v + 1), "n": n, "v": v}, sums


def _planes(x: np.ndarray, n: int) -> np.ndarray:
    """The low n bytes of the numbers, all lowest bytes first: what is sorted compresses so."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, :n].T).reshape(-1)


def _numbers(planes: np.ndarray, n: int, kind: str) -> np.ndarray:
    m = len(planes) // n
    out = np.zeros((m, np.dtype(kind).itemsize), np.uint8)
    out[:, :n] = planes.reshape(n, m).T
    return out.view(kind).reshape(-1)


class Codes:
    """Two-byte codes of the most frequent words."""

    def __init__(self, by_rank: np.ndarray):
        self.by_rank = by_rank[:RARE]
        self.order = np.argsort(self.by_rank)
        self.sorted = self.by_rank[self.order]

    def of(self, x: np.ndarray) -> np.ndarray:
        at, known = among(self.sorted, x)
        return np.where(known, self.order[at] if len(self.order) else 0, RARE).astype("<u2")

    def hashes(self, codes: np.ndarray, rare: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes), np.uint64)
        known = codes != RARE
        out[known], out[~known] = self.by_rank[codes[known]], rare
        return out


def word_part(w: np.ndarray, parts: int) -> np.ndarray:
    """Word partitions are ranges of hashes, so that sorted ones share their high bytes."""
    return ((w >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def context_part(c: np.ndarray, parts: int) -> np.ndarray:
    return ((c >> np.uint64(8)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(a) for a in arrays], "<i4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, "<i4", len(types))
    out, at = [], 4 * len(types)
    for n, t in zip(sizes, types, strict=True):
        out.append(np.frombuffer(raw, t, n, at))
        at += int(n) * np.dtype(t).itemsize
    return out


class Part:
    """A word partition: its Cells, the cell of each token, the token's text number and the (block, number) of each text.

    Contexts are numbered with the hot ones first, then by context partition and hash.
    """

    def __init__(self, blobs: list[tuple[int, bytes]], part: int, hot: np.ndarray, parts: int, codes: Codes):
        words, times, ctxs, train, docs, self.keys, base = [], [], [], [], [], [], 0
        for block, blob in blobs:
            w, rare_w, n, x, rare_x, d = _unpack(blob, "u1", "u1", "<i4", "u1", "u1", "u1")
            d = _numbers(d, 2, "<u2")
            words.append(codes.hashes(_numbers(w, 2, "<u2"), _numbers(rare_w, 8, "<u8")))
            times.append(n)
            ctxs.append(codes.hashes(_numbers(x, 2, "<u2"), _numbers(rare_x, 5, "<u8")) & CTX)
            train.append(d & HELD == 0)
            d = d & ~HELD
            top = int(d.max()) + 1 if len(d) else 0
            docs.append(d.astype(np.int32) + base)
            self.keys.append((block, top))
            base += top
        self.doc, train = np.concatenate(docs), np.concatenate(train)
        distinct, wid = np.unique(np.concatenate(words), return_inverse=True)
        wid = np.repeat(wid.astype(np.int32), np.concatenate(times))
        known, number = np.unique(np.concatenate(ctxs), return_inverse=True)
        number = number.astype(np.int32)
        ctxs = words = docs = None
        hot_context = np.sort(hot & CTX)
        of_context = np.argsort(hot & CTX, kind="stable")
        where, is_hot = among(hot_context, known)
        where = of_context[where] if len(hot) else where
        to = np.where(is_hot, -1, context_part(known, parts)).astype(np.int64)
        order = np.lexsort((known, to))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.contexts, to = known[order], to[order]
        self.n_cold = int((to >= 0).sum())
        self.hot_ctx = where[order][: len(order) - self.n_cold]
        self.to, first = np.unique(to[to >= 0], return_index=True)
        self.cuts = np.append(first, self.n_cold) + len(self.hot_ctx)
        n_ctx = len(known)
        key, cell = np.unique(wid * np.int64(n_ctx) + place[number], return_inverse=True)
        self.cell = cell.astype(np.int32)
        number = wid = cell = None
        count = np.bincount(self.cell[train], minlength=len(key)).astype(float)
        where, is_hot = among(hot, distinct)
        self.cells = Cells(key // n_ctx, key % n_ctx, count, len(distinct), part + 1, n_ctx, np.where(is_hot, where, -1), len(hot))

    def cut(self, *vectors: np.ndarray) -> list[bytes]:
        """By context partition, the pieces of vectors over contexts."""
        return [_pack(*(v[a:b].astype("<i8") for v in vectors)) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def to_driver(self, x: np.ndarray) -> np.ndarray:
        """A vector that starts with numbers by context, with those by hot context instead."""
        n = self.cells.n_ctx
        return np.concatenate([np.bincount(self.hot_ctx, x[: len(self.hot_ctx)], self.cells.n_hot), x[n:]])

    def history(self, answers: pa.Table, hot_customers: np.ndarray, driver: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Customers by context, and the vectors of sums after each round, from the answers and the driver's vectors."""
        got = {(k, q): b for k, q, b in zip(*(answers.column(c).to_pylist() for c in ("k", "q", "vals")), strict=True)}
        h = len(hot_customers)
        out, customers = [], None
        for k, x in enumerate(driver):
            pieces = [_unpack(got[k, q], *["<i8"] * (2 if k == 0 else 1)) for q in self.to.tolist()]
            if k == 0:
                customers = np.concatenate([hot_customers[self.hot_ctx], *(p[0] for p in pieces)]).astype(float)
            out.append(np.concatenate([x[:h][self.hot_ctx], *(p[-1] for p in pieces), x[h:]]).astype(float))
        return customers, out


def added(key: tuple, lists: pa.Table, sent: pa.Table, k: int) -> pa.Table:
    """The answers of a context partition: for each word partition the sums of its contexts over all."""
    vals = dict(zip(sent.column("part").to_pylist(), sent.column("vals").to_pylist(), strict=True))
    parts = lists.column("part").to_pylist()
    contexts = [_numbers(_unpack(b, "u1")[0], 5, "<u8") for b in lists.column("contexts").to_pylist()]
    _, at = np.unique(np.concatenate(contexts), return_inverse=True)
    x = [_unpack(vals[p], *["<i8"] * (2 if k == 0 else 1)) for p in parts]
    sums = [np.bincount(at, np.concatenate(v))[at].astype("<i8") for v in zip(*x, strict=True)]
    cuts = np.cumsum([0, *map(len, contexts)])
    blobs = [_pack(*(v[a:b] for v in sums)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"part": pa.array(parts, pa.int32()), "q": pa.array([key[0].as_py()] * len(parts), pa.int32()), "k": pa.array([k] * len(parts), pa.int32()), "vals": pa.array(blobs, pa.binary())})


def block_key(ids: list[int | None], raws: list[bytes]) -> int:
    """63 bits of a block's ids, lengths and texts: blocks that share a key hold the same rows, each with its own text."""
    h = xxhash.xxh3_64(repr([(i, len(r)) for i, r in zip(ids, raws, strict=True)]).encode())
    h.update(b"".join(raws))
    return h.intdigest() >> 1


def bucketed(df: DataFrame, n: int, key: str, tag: str) -> DataFrame:
    """df as files in n buckets by key, in the shared folder; only their writing needs a name, which goes at once."""
    spark, name = df.sparkSession, f"prosemill_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", scratch(spark, tag)).option("compression", "none").format("parquet").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved to its files and buckets by now
    spark.sql(f"DROP TABLE {name}")  # a table with a path of its own leaves its files
    return table


def score(docs: DataFrame, samples: int = 2, strength: float = 1.0, parent_strength: float = 10.0, held_out_fold: int = 2, folds: int = 7, block_mb: float = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (10 to minus the score a token)."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = partitions(docs, 5)
    rows = slim.count()
    # the words so frequent in a sample that they stay where they are
    hasher = Hasher()

    def often(batches):
        for batch in batches:
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]
            if raws:
                tok, _, _ = tokens_of(raws, hasher)
                w, n = np.unique(tok, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n), pa.array(np.where(np.arange(len(w)) == 0, len(tok), 0))], ["w", "n", "total"])

    few = slim.sample(min(1.0, 3000 / max(1, rows)), 11).select("text").mapInArrow(often, "w long, n long, total long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    few = few.select("w", "n", F.sum("total").over(Window.partitionBy()).alias("total")).where("n > 1").orderBy(F.desc("n"), "w").limit(RARE).toPandas()  # at most RARE words
    by_rank = few["w"].to_numpy(np.int64).view(np.uint64)
    hot = np.sort(by_rank[few["n"].to_numpy(np.int64) * HOT_SHARE >= few["total"].to_numpy(np.int64)])
    codes = spark.sparkContext.broadcast(Codes(by_rank))

    def encode(batches):
        hash_ = held("hasher", Hasher)
        limit = int(block_mb * 1e6)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            a = 0
            while a < len(ids):
                b, size = a, 0
                while b < len(ids) and size < limit and b - a < 1 << 15:
                    size += len(texts[b] or "")
                    b += 1
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]]
                own = ids[a:b]
                away = np.array([zlib.crc32(str("" if i is None else i).encode()) % folds == held_out_fold for i in own])
                tok, ctx, doc = tokens_of(raws, hash_)
                block = block_key(own, raws)
                (ha, hot_word), (hc, hot_ctx) = among(hot, tok), among(hot, ctx)
                stay = hot_word & hot_ctx
                known_ids = np.array([0 if i is None else i for i in own], "<i8")
                meta = _pack(known_ids, np.array([i is None for i in own], "u1"), away.astype("u1"), np.bincount(doc, minlength=len(own)).astype("<i4"), ha[stay].astype("<u2"), hc[stay].astype("<u2"), doc[stay].astype("<u2"))
                out = [(-1 - (block & 0xFFF), block, meta)]
                w, c, d = tok[~stay], ctx[~stay] & CTX, doc[~stay] | np.where(away[doc[~stay]], HELD, np.uint16(0))
                p = np.where(hot_word[~stay], context_part(c, parts), word_part(w, parts))
                x = codes.value.of(ctx[~stay])
                tok = ctx = doc = ha = hc = hot_word = hot_ctx = stay = None
                order = np.lexsort((x, w, p))
                w, c, d, p, x = w[order], c[order], d[order], p[order], x[order]
                v = codes.value.of(w)
                cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)] if len(p) else [0]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    new = i + np.flatnonzero(np.concatenate([[True], w[i + 1 : j] != w[i : j - 1]]))
                    rare_w, rare_x = w[new][v[new] == RARE], c[i:j][x[i:j] == RARE]
                    out.append((int(p[i]), block, _pack(_planes(v[new], 2), _planes(rare_w, 8), np.diff(np.append(new, j)).astype("<i4"), _planes(x[i:j], 2), _planes(rare_x, 5), _planes(d[i:j], 2))))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["part", "block", "blob"])
                a = b

    blobs = bucketed(slim.mapInArrow(encode, "part int, block long, blob binary"), parts, "part", "token-blobs")
    cold, metas = blobs.where("part >= 0"), blobs.where("part < 0").select("block", "blob")

    def hot_counts(batches):
        total = np.zeros(len(hot) * CONTEXTS, np.int64)
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                _, _, away, _, a, c, d = _unpack(blob, "<i8", "u1", "u1", "<i4", "<u2", "<u2", "<u2")
                keep = away[d] == 0
                total += np.bincount(a[keep].astype(np.int64) * CONTEXTS + c[keep], minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    n_hot = len(hot)
    hot_cells = None
    if n_hot:
        table = metas.mapInArrow(hot_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most HOT_SHARE * CONTEXTS rows
        count = np.zeros(n_hot * CONTEXTS)
        count[table["cell"].to_numpy(np.int64)] = table["n"].to_numpy(float)
        cell = np.arange(len(count)).reshape(n_hot, CONTEXTS)[:, :n_hot].ravel()
        hot_cells = Cells(cell // CONTEXTS, cell % CONTEXTS, count[cell], n_hot, 0, n_hot, np.arange(n_hot), n_hot)

    def opened(key: tuple, rows_: pa.Table) -> Part:
        part = key[0].as_py()
        # equal texts make equal blocks: the order of the rows changes nothing
        return Part(list(zip(rows_.column("block").to_pylist(), rows_.column("blob").to_pylist(), strict=True)), part, hot, parts, codes.value)

    def messages(key: tuple, p: Part, pieces: list[bytes], driver: np.ndarray, contexts: bool) -> pa.Table:
        part = key[0].as_py()
        lists = {"contexts": pa.array([_pack(_planes(p.contexts[a:b], 5)) for a, b in zip(p.cuts[:-1], p.cuts[1:], strict=True)] + [b""], pa.binary())} if contexts else {}
        return pa.table({"q": pa.array([*p.to.tolist(), -1], pa.int32()), "part": pa.array([part] * (len(pieces) + 1), pa.int32()), "vals": pa.array([*pieces, _pack(driver)], pa.binary())} | lists)

    def summed(sent: DataFrame, size: int) -> np.ndarray:
        """The sum of the vectors for the driver."""

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    total += _unpack(blob, "<f8")[0]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "x"])

        got = sent.where("q < 0").select("vals").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
        out = np.zeros(size)
        out[got["at"].to_numpy(np.int64)] = got["x"].to_numpy(float)
        return out

    def start(key, rows_):
        p = opened(key, rows_)
        c = p.cells
        customers = np.bincount(c.ctx, c.count, c.n_ctx)
        sums = c.sums(*c.first())
        driver = np.concatenate([p.to_driver(customers)[:n_hot], p.to_driver(sums), c.counts(), np.bincount(c.hot, c.word_count[c.hot_words], n_hot)])
        return messages(key, p, p.cut(customers, sums), driver, True)

    lists = bucketed(cold.groupBy("part").applyInArrow(start, "q int, part int, vals binary, contexts binary"), parts, "q", "context-lists")
    stats = summed(lists, 5 * n_hot + 8)
    stats, hot_count = stats[: 4 * n_hot + 8], stats[4 * n_hot + 8 :]
    if hot_cells:
        stats += hot_cells.stats()
        hot_count = hot_count + hot_cells.word_count
        cw = stats[2 * n_hot : 3 * n_hot]
        stats[3 * n_hot : 4 * n_hot] = cw > 0
        stats[4 * n_hot + 1] += (cw > 0).sum()
        stats[-4:-1] += [(cw == 1).sum(), (cw == 2).sum(), (hot_count > 0).sum()]
    g, sums = _constants(stats, strength, parent_strength, n_hot)
    history = [sums]
    answer_schema = "part int, q int, k int, vals binary"
    of_contexts = lists.where("q >= 0")
    answers = saved(of_contexts.groupBy("q").applyInArrow(lambda key, rows_: added(key, rows_, rows_, 0), answer_schema), "context-sums")

    def sweep(seen: list[np.ndarray]):
        def run(key, rows_, answered):
            p = opened(key, rows_)
            _, own = p.history(answered, g["customers"], seen)
            *_, last = p.cells.samples(g, own)
            sums = p.cells.sums(*last)
            return messages(key, p, p.cut(sums), p.to_driver(sums), False)

        return run

    def add(k: int):
        return lambda key, contexts, sent: added(key, contexts, sent, k)

    for k in range(1, samples + 1 if g["n"] else 1):
        seen = list(history)

        sent = saved(cold.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(sweep(seen), "q int, part int, vals binary"), "context-tables")
        sums = summed(sent, 3 * n_hot + 2)
        if hot_cells:
            *_, last = hot_cells.samples(g, seen)
            sums += hot_cells.sums(*last)
            tables = seat(sums[n_hot : 2 * n_hot], np.full(n_hot, (g["s0"] + g["d0"] * seen[-1][-1]) * g["base"]), g["d0"], np.random.default_rng([0, k, 1]))
            sums[2 * n_hot : 3 * n_hot] = tables
            sums[-1] += tables.sum()
        history.append(sums)
        more_ = of_contexts.select("q", "part", "contexts").groupBy("q").cogroup(sent.where("q >= 0").groupBy("q")).applyInArrow(add(k), answer_schema)
        answers = answers.unionByName(saved(more_, "context-sums"))
    scale = np.log10(g["n"] + g["v"] + 1)
    part_schema = "block long, sums binary, meta binary"

    def fixed(x: np.ndarray) -> np.ndarray:
        return _planes(np.rint(-x * (1 << FINE)).astype("<u8"), 8)

    def packed(use: np.ndarray, score_: np.ndarray, base: np.ndarray, known: np.ndarray) -> bytes:
        """Sums of the texts use (their numbers) of a block."""
        return _pack(use.astype("<u2"), fixed(score_), fixed(base), _planes(known.astype("<u4"), 4))

    def cold_scores(key, rows_, answered):
        p = opened(key, rows_)
        customers, own = p.history(answered, g["customers"], history)
        cells, doc = p.cells, p.doc
        logs = cells.log_probability(g | {"customers": customers}, own)
        count = cells.word_count
        count[cells.hot_words] = hot_count[cells.hot]
        base = np.log10(count + 1) - scale
        n = sum(top for _, top in p.keys)
        words = cells.word[p.cell]
        sums_ = [np.bincount(doc, x, n) for x in (logs[p.cell], base[words], (count > 0)[words].astype(float))]
        there, at, out = np.bincount(doc, minlength=n) > 0, 0, []
        for _, top in p.keys:
            use = np.flatnonzero(there[at : at + top])
            out.append(packed(use, *(x[at : at + top][use] for x in sums_)))
            at += top
        return pa.table({"block": pa.array([b for b, _ in p.keys], pa.int64()), "sums": pa.array(out, pa.binary()), "meta": pa.array([None] * len(out), pa.binary())})

    hot_logs = spark.sparkContext.broadcast(None if hot_cells is None else (hot_cells.log_probability(g, history).reshape(n_hot, n_hot), np.log10(hot_count + 1) - scale, hot_count > 0))

    def doc_rows(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, null, away, n_tokens, a, c, d = _unpack(blob, "<i8", "u1", "u1", "<i4", "<u2", "<u2", "<u2")
                m = len(ids)
                sums_ = [np.zeros(m)] * 3
                if hot_logs.value and len(a):
                    logs, base, known = hot_logs.value
                    sums_ = [np.bincount(d, x, m) for x in (logs[a, c], base[a], known[a].astype(float))]
                own = _pack(ids, null, away, n_tokens)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed(np.arange(m), *sums_)], pa.binary()), pa.array([own], pa.binary())], ["block", "sums", "meta"])

    def merged(key, rows_):
        metas_ = [b for b in rows_.column("meta").to_pylist() if b is not None]
        # equal blocks of equal rows share a key: each of the copies gets its part of the sums
        copies = len(metas_)
        ids, null, away, n_tokens = _unpack(metas_[0], "<i8", "u1", "u1", "<i4")
        total = np.zeros((3, len(ids)))
        for blob in rows_.column("sums").to_pylist():
            use, *x = _unpack(blob, "<u2", "u1", "u1", "u1")
            for k in (0, 1):
                total[k, use] -= _numbers(x[k], 8, "<u8").astype(float) / (1 << FINE)
            total[2, use] += _numbers(x[2], 4, "<u4")
        total /= copies
        out = {"doc_id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "held_out": pa.array(away.astype(bool)), "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(np.rint(total[2]).astype(np.int64)), "base_score": pa.array(total[1]), "score": pa.array(total[0])}
        return pa.concat_tables([pa.table(out)] * copies)

    ends = metas.mapInArrow(doc_rows, part_schema)
    every = ends.unionByName(cold.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(cold_scores, part_schema))
    rows_out = every.groupBy("block").applyInArrow(merged, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return rows_out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(g["n"])).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
