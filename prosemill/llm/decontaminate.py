"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Items and documents are sequences of words (A-Z lowered). A document is
contaminated if some stretch of it is within edit distance (1 - similarity) * n
of an item of n words.

Embedding. The CGK random walk copies the word it stands on and moves to the
next one if a random bit of (step, word) says so, which turns few edits into few
differing coordinates. Two walks that start in step agree until an edit, and fall
into step again after many of them.

Buckets. A repetition has its own random bits and samples WORDS coordinates of
the walk; windows that agree in all of them share a bucket. An item within its
limit may have an edit at every fifth word, so coordinates sampled from the whole
of an item-sized window would hardly ever agree: a window starts at every word of
an item and of a document, and coordinates are sampled from its first steps. Of n
words with e edits some ceil((n - e) / (e + 1)) in a row are unchanged, three in
most cases. A repetition puts a window that starts there into the item's bucket
with probability 1/4 at least (each of the two moves between its three
coordinates comes out with probability 1/2), and REPEATS brings the chance of a
miss for one such run below 1 - RECALL; items have several runs. Buckets whose
coordinates fall on the same word twice say little and are left out.

Verification. A stretch around a collision that holds enough of the item's words
is checked by the exact edit distance (it may be longer or shorter than the item).
Items that allow no edit are looked up whole.

Defined results: null and empty texts and items match nothing; items too short
for an edit (below five words at 0.8) must match exactly; repeated items and rows
are judged one by one; null item ids are left out; extra columns stay or are
ignored; with no items nothing is contaminated; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, held, saved, text_blocks

WORDS, RECALL, SEED = 3, 0.99, 7
#: Repetitions that bring the miss of a run of unchanged words below 1 - RECALL.
REPEATS = int(np.ceil(np.log(1 - RECALL) / np.log(1 - 0.5 ** (WORDS - 1))))
#: Sampled coordinates of the repetitions, in turn: one or two steps apart, where a single move has probability 1/2.
COORDINATES = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4)]
BITS = 21


def _steps() -> np.ndarray:
    """The random multipliers of each repetition's walk."""
    return np.random.default_rng(SEED).integers(1, 1 << 63, (REPEATS, 1 + max(max(c) for c in COORDINATES)), dtype=np.uint64) | np.uint64(1)


STEPS = _steps()


def buckets(h: np.ndarray, r: int, words: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For every start in h: the walk's places at the sampled coordinates of repetition r, and the bucket after each of them."""
    n = len(h)
    padded = np.concatenate([h, np.zeros(STEPS.shape[1], np.uint64)])
    at, key = np.arange(n), np.full(n, r, np.uint64)
    places, keys = [], []
    coordinates = COORDINATES[r % len(COORDINATES)][:words]
    with np.errstate(over="ignore"):
        for j in range(coordinates[-1] + 1):
            s = padded[at]
            if j in coordinates:
                key = (key ^ s) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
                places.append(at)
                keys.append(key)
            if j < coordinates[-1]:
                at = at + (((s + np.uint64(j)) * STEPS[r, j]) >> np.uint64(63)).astype(np.int64)
    return places, keys


def grams(h: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = (out ^ h[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out


def edit_distance_inside(item: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance of the item to any stretch of text."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for k, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = k + 1
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


class Table:
    """Buckets of item windows: sorted keys with their item and offset, and a bit map of the keys."""

    def __init__(self, keys: list[np.ndarray], items: list[np.ndarray], offsets: list[np.ndarray]):
        keys, items, offsets = (np.concatenate(x) for x in (keys, items, offsets))
        order = np.argsort(keys, kind="stable")
        self.keys, self.items, self.offsets = keys[order], items[order].astype(np.int32), offsets[order].astype(np.int32)
        self.map = np.zeros(1 << BITS, bool)
        self.map[(self.keys & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True

    def collisions(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, item, offset) of the windows whose buckets are g, window k starting at k."""
        at = np.flatnonzero(self.map[(g & np.uint64((1 << BITS) - 1)).astype(np.int64)])
        lo = np.searchsorted(self.keys, g[at], "left")
        n = np.searchsorted(self.keys, g[at], "right") - lo
        cells = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(n) else lo
        return np.repeat(at, n), self.items[cells], self.offsets[cells]


class Matcher:
    def __init__(self, items: list[tuple[int, list[int]]], similarity: float):
        self.items = [(i, np.array(w, np.uint64)) for i, w in items if len(w)]
        self.edits = [int((1 - similarity) * len(w) + 1e-9) for _, w in self.items]
        whole: dict[int, list] = {}
        parts: dict[tuple[int, int], list] = {}
        for k, (_, w) in enumerate(self.items):
            n, e = len(w), self.edits[k]
            if not e:
                size = min(n, 4)
                whole.setdefault(size, []).append((grams(w, size)[:1], np.array([k]), np.zeros(1, np.int64)))
                continue
            words = min(WORDS, -(-(n - e) // (e + 1)))
            for r in range(REPEATS):
                places, keys = buckets(w, r, words)
                apart = places[-1] < n
                for a, b in zip(places[:-1], places[1:], strict=True):
                    apart &= a < b
                o = np.flatnonzero(apart)
                parts.setdefault((r, words), []).append((keys[-1][o], np.full(len(o), k), o))
        self.whole = {size: Table(*zip(*v, strict=True)) for size, v in whole.items()}
        self.parts = {key: Table(*zip(*v, strict=True)) for key, v in parts.items()}
        self.vocabulary = [np.unique(w) for _, w in self.items]
        self.known = np.unique(np.concatenate(self.vocabulary)) if self.items else np.zeros(0, np.uint64)

    def candidates(self, h: np.ndarray):
        """(start of the item's match, items) for the collisions of each table; starts may repeat."""
        for size, table in self.whole.items():
            at, k, o = table.collisions(grams(h, size))
            yield at, at - o, k
        for r in range(REPEATS):
            sizes = [words for q, words in self.parts if q == r]
            if sizes:
                _, keys = buckets(h, r, max(sizes))
                for words in sizes:
                    at, k, o = self.parts[r, words].collisions(keys[words - 1])
                    yield at, at - o, k

    def _enough(self, h: np.ndarray, first: np.ndarray, doc: np.ndarray, k: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which stretches hold as many of the item's words as a match needs."""
        number = np.searchsorted(self.known, h)
        number[self.known[np.minimum(number, len(self.known) - 1)] != h] = len(self.known)
        member = np.zeros(len(self.known) + 1, bool)
        keep = np.zeros(len(k), bool)
        by_item = np.argsort(k, kind="stable")
        cuts = np.flatnonzero(np.diff(k[by_item])) + 1
        for rows in np.split(by_item, cuts):
            t = int(k[rows[0]])
            n, e = len(self.items[t][1]), self.edits[t]
            a, b = np.maximum(first[doc[rows]], start[rows] - e), np.minimum(first[doc[rows] + 1], start[rows] + n + 3 * e)
            mine = np.searchsorted(self.known, self.vocabulary[t])
            member[mine] = True
            low, high = int(a.min()), int(b.max())
            before = np.concatenate([[0], np.cumsum(member[number[low:high]])])
            keep[rows] = before[b - low] - before[a - low] >= n - e
            member[mine] = False
        return keep

    def block(self, h: np.ndarray, first: np.ndarray) -> dict[int, set]:
        """Item ids found by text number; h: word hashes of all texts, first: each text's first word and the total."""
        found: dict[int, set] = {}
        places = [x for x in self.candidates(h) if len(x[0])]
        if not places:
            return found
        at, start, k = (np.concatenate(x) for x in zip(*places, strict=True))
        doc = np.searchsorted(first, at, "right") - 1
        # distinct (text, item, start), in this order
        order = np.lexsort((start, k, doc))
        doc, k, start = doc[order], k[order], start[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (k[1:] != k[:-1]) | (start[1:] != start[:-1])])
        doc, k, start = doc[new], k[new], start[new]
        keep = self._enough(h, first, doc, k, start)
        doc, k, start = doc[keep], k[keep], start[keep]
        last, done = None, -1
        for d, t, s in zip(doc.tolist(), k.tolist(), start.tolist(), strict=True):
            item_id, w = self.items[t]
            n, e = len(w), self.edits[t]
            if (d, t) != last:
                last, done = (d, t), -(1 << 60)
            # neighbouring collisions share one check; what is found is done with
            if s <= done or item_id in found.get(d, ()):
                continue
            done = s + e
            a, b = max(int(first[d]), s - e), min(int(first[d + 1]), s + n + 3 * e)
            if edit_distance_inside(w, h[a:b]) <= e:
                found.setdefault(d, set()).add(item_id)
        return found


def _item_blocks(items: DataFrame, hasher: Hasher, max_items: int, max_words: int):
    """Lists of (item id, word hashes) in the order of the ids, of at most max_items items and max_words words, or one item."""
    block, size = [], 0
    for r in items.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        h, _ = hasher.words([r.text.encode("utf-8", "surrogatepass")])
        if block and (len(block) == max_items or size + len(h) > max_words):
            yield block
            block, size = [], 0
        block.append((r.item_id, h.tolist()))
        size += len(h)
    yield block


def _found(docs: DataFrame, items: DataFrame, names: list[str], similarity: float, text_col: str, max_items: int = 20_000, max_words: int = 200_000) -> DataFrame:
    """The columns names of docs as c0, c1 ... and items.

    The items go to every task in blocks of at most max_items items and max_words words (a longer item is a block of
    its own); documents pass one block after the other, and between blocks they are saved.
    """
    # the text is read by every block, and the lists found so far go along
    slim = docs.select(*(F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)), F.col(text_col).alias("text"), F.lit(None).cast("array<long>").alias("items"))
    schema = slim.schema
    m = len(names)

    def against(words: list):
        shared, tag = docs.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex

        def run(batches):
            hash_, matcher = held("hasher", Hasher), held("matcher", lambda: Matcher(shared.value, similarity), tag)
            for batch in batches:
                found = [set(x or ()) for x in batch.column(m + 1).to_pylist()]
                for row, raws in text_blocks(batch, m):
                    for d, ids in matcher.block(*hash_.words(raws)).items():
                        found[row + d] |= ids
                yield pa.RecordBatch.from_arrays([*batch.columns[: m + 1], pa.array([sorted(x) for x in found], pa.list_(pa.int64()))], schema.names)

        return run

    out = None
    for words in _item_blocks(items, Hasher(), max_items, max_words):
        out = (slim if out is None else saved(out, "items-found")).mapInArrow(against(words), schema)
    return out.select(*(f"c{k}" for k in range(m)), "items")


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **blocks) -> DataFrame:
    """doc_id, items (sorted ids of the items found) and contaminated; blocks: max_items and max_words of a block of items."""
    found = _found(docs, items, [id_col], similarity, text_col, **blocks)
    return found.select(F.col("c0").alias(id_col), "items", (F.size("items") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, similarity: float = 0.8, text_col: str = "text", **blocks) -> DataFrame:
    """The documents without a benchmark passage, with their own columns."""
    found = _found(docs, items, docs.columns, similarity, text_col, **blocks)
    return found.where(F.size("items") == 0).select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(docs.columns)))
