"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

Sketch. Every shingle is thrown into one of T bins by a hash of its own in each
round; a bin keeps the least (round, value) that reached it. In the first T
rounds the bin is hashed; in round T + b it is bin b for every shingle, so all T
coordinates fill, and small sets agree with their Jaccard similarity in
expectation with the concentration of T independent draws.

Classes. Equal shingle sets form a class that the rest of the work sees once.
Bands of ROWS coordinates put classes into buckets. In a bucket, members are
compared with a hub (the member that meets most others) rather than with each
other; a verified link joins components. What is still in different components
after the hub rounds is compared in bounded blocks on the full shingle sets, each
of which gives a spanning forest of its links, so no link between components is
lost. Every link is confirmed on the full shingle sets.

Defined results: null, empty and blank texts have an empty set and link with
nothing; a text with fewer words than the shingle size is one shingle; rows with
one id are one document, whose text is the one with the fewest shingles (then
the least digest of them); rows with a null id are rows of their own, linked with
nothing and kept, with null as class and component; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, lower_words, partitions, saved, word_hashes

T, ROWS = 128, 4
#: Sketch agreement below which a pair is ruled out: so many standard deviations of T draws below the threshold
#: (in the hub rounds alone; a linked pair ruled out there, 3 in a million, is left to the blocks of full sets).
SLACK = 4.5
#: Members of a bucket are compared in chunks of about so many members and set elements.
CHUNK, CHUNK_IDS = 1000, 1_000_000
#: Ids of at most FEW sets of a block are counted pair by pair; TILE bounds the cells of a matrix of the others.
FEW, TILE = 12, 8_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(words: list[bytes], size: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit shingle ids; fewer words than size make one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words, cache)
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def sketch(ids: np.ndarray, t: int = T) -> np.ndarray:
    """The fast similarity sketch of a set: t 64-bit coordinates, all filled."""
    out, left = np.zeros(t, np.uint64), np.ones(t, bool)
    with np.errstate(over="ignore"):
        for r in range(2 * t):
            h = _mix(ids + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            if r < t:
                bins = (h >> np.uint64(48)) % np.uint64(t)
                value = h & np.uint64(0xFFFFFFFFFFFF)
                order = np.lexsort((value, bins)) if len(h) > 1 else np.zeros(len(h), np.intp)
                b, v = bins[order].astype(np.intp), value[order]
                first = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, bool)
                b, v = b[first], v[first]
                new = left[b]
                out[b[new]] = _mix(v[new] + np.uint64(r << 48))
                left[b[new]] = False
            elif left[r - t]:
                out[r - t] = _mix((h & np.uint64(0xFFFFFFFFFFFF)).min() + np.uint64(r << 48))
                left[r - t] = False
            if not left.any():
                break
    return out


def _sets(docs: DataFrame, size: int, with_set: bool, with_sketch: bool) -> DataFrame:
    """doc_id, mark, n, key (digest of the set) and the set (sorted 64-bit ids) or its sketch as binary."""
    import xxhash

    def run(batches):
        cache = held("words", dict)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                n, key, sets, sketches = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = shingle_set(lower_words(text), size, cache)
                    raw = ids.astype("<u8").tobytes()
                    n.append(len(ids))
                    key.append(xxhash.xxh3_128_digest(raw))
                    sets.append(raw if with_set else None)
                    sketches.append(sketch(ids).astype("<u8").tobytes() if with_sketch and len(ids) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sets, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "mark", "n", "key", "ids", "sketch"])

    return docs.select("doc_id", "text", "mark").mapInArrow(run, "doc_id long, mark long, n long, key binary, ids binary, sketch binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """One row per class and band: bucket (64-bit), id, n and the low bytes of the sketch."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column(0).to_numpy()
                m = len(ids)
                if not m:
                    continue
                s = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(m, T)
                bands = s.reshape(m, T // ROWS, ROWS)
                h = np.broadcast_to(np.arange(T // ROWS, dtype=np.uint64), (m, T // ROWS)).copy()
                for j in range(ROWS):
                    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j])
                yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, T // ROWS))], ["bucket", "id"])

    return classes.select("id", "sketch").mapInArrow(run, "bucket long, id long")


def _agreement(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose sketches agree in a share of at least `least` coordinates."""
    j = pairs.join(sketches.select(F.col("id").alias("a"), F.col("small").alias("sa")), "a").join(sketches.select(F.col("id").alias("b"), F.col("small").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(m, T) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((sa == sb).sum(axis=1) >= least * T))

    return j.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of sets[left] with sets[right].

    Ids of few sets are counted pair by pair; the others (a small part of all) are the columns of 0/1 matrices whose
    product, taken some columns at a time, counts what two sets share.
    """
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    row = np.repeat(np.arange(m), sizes)
    ids = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    held_by = np.diff(np.concatenate([start, [len(ids)]]))
    each = np.repeat(held_by, held_by)
    column = np.repeat(np.arange(len(start)), held_by)
    few = (each > 1) & (each <= FEW)
    r, c = row[few], column[few]
    out = np.zeros(m * m, np.int64)
    for shift in range(1, FEW):
        same = c[shift:] == c[:-shift]
        if not same.any():
            break
        out += np.bincount(r[:-shift][same] * m + r[shift:][same], minlength=m * m)
    out = out.reshape(m, m)
    out = (out + out.T)[np.ix_(left, right)]
    many = each > FEW
    if many.any():
        r, c = row[many], column[many]
        c = np.cumsum(np.concatenate([[0], c[1:] != c[:-1]]))
        step = max(1, TILE // m)
        for low in range(0, int(c[-1]) + 1, step):
            a, b = np.searchsorted(c, [low, low + step])
            x = np.zeros((m, min(step, int(c[-1]) + 1 - low)), np.float32)
            x[r[a:b], c[a:b] - low] = 1
            out += np.rint(x[left] @ x[right].T).astype(np.int64)
    return out


def joining_links(rows: list[tuple[int, int, np.ndarray]], own: np.ndarray, lo: int, hi: int, percent: int) -> list[tuple[int, int]]:
    """Confirmed links of a block of (id, component, set) that join its components, a spanning forest of them.

    Only pairs of a row of chunk lo with one of chunk hi count.
    """
    left = np.flatnonzero(own == lo)
    right = left if lo == hi else np.flatnonzero(own == hi)
    label = np.array([r[1] for r in rows])
    if not len(left) or not len(right) or (label == label[0]).all():
        return []
    sizes = np.array([len(r[2]) for r in rows])
    both = common_counts([r[2] for r in rows], left, right)
    linked = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
    out = []
    for k, near in zip(left.tolist(), linked, strict=True):
        other = right[near & (label[right] != label[k])]
        joined, first = np.unique(label[other], return_index=True)
        out.extend((min(rows[k][0], rows[x][0]), max(rows[k][0], rows[x][0])) for x in other[first].tolist())
        if len(joined):
            label[np.isin(label, joined)] = label[k]
    return out


def _links_in_buckets(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join the components of a bucket.

    rows: bucket, id, n, component. A bucket is cut into chunks bounded in rows and in set elements, and each pair of
    chunks is one bounded piece of work, which compares full sets where they are and gives at most one link for every
    component it holds. No task grows with a bucket; the rows do, with its square over the size of a chunk, where a
    bucket still holds several components after the hub rounds.
    """
    chunks = saved(rows.groupBy("bucket").agg(F.expr(f"cast(ceil(greatest(count(*) / {CHUNK}, sum(n) / {CHUNK_IDS})) as int)").alias("c")), "bucket-chunks")
    placed = rows.join(chunks, "bucket").withColumn("own", F.expr("cast(pmod(xxhash64(id), c) as int)"))
    blocks = placed.select("bucket", "id", "component", "own", F.explode(F.expr("sequence(0, c - 1)")).alias("other"))
    blocks = blocks.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "component").join(sets, "id")

    def run(batches):
        key, own, group = None, [], []

        def links():
            found = joining_links(group, np.array(own), key[1], key[2], percent) if len(group) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for *now, mine, id_, comp, ids in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if now != key:
                    if len(group) > 1:
                        yield links()
                    key, own, group = now, [], []
                own.append(mine)
                group.append((id_, comp, np.frombuffer(ids, "<u8")))
        if len(group) > 1:
            yield links()

    dealt = blocks.select("bucket", "lo", "hi", "own", "id", "component", "ids").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets satisfy 100 * intersection >= percent * union."""
    j = pairs.join(sets.select(F.col("id").alias("a"), F.col("ids").alias("ia")), "a").join(sets.select(F.col("id").alias("b"), F.col("ids").alias("ib")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), "<u8") for v in (x, y))
                both = len(x) + len(y)
                z = np.concatenate([x, y])
                z.sort()
                common = int((z[1:] == z[:-1]).sum())
                keep.append(100 * common >= percent * (both - common))
            if any(keep):
                yield batch.select([0, 1]).filter(pa.array(keep))

    return j.select("a", "b", "ia", "ib").mapInArrow(run, "a long, b long")


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds; (id, component), component the least id.

    Only ids with a link appear. Each round is written to the shared folder.
    """
    edges = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), tag)
    while True:
        # done when the edges are stars: every larger end has one smaller end, which is no larger end itself
        roles = edges.select(F.col("b").alias("id"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(edges.select(F.col("a").alias("id"), F.lit(0).alias("low"), F.lit(1).alias("high")))
        bad = roles.groupBy("id").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or low > 0 and high > 0")
        if bad.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        edges = saved(small, tag)
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def _merged(comp: DataFrame | None, links: DataFrame, turn: int) -> DataFrame:
    """comp with the links added: what they join are the components so far."""
    if comp is None:
        return saved(components(links), f"components-{turn}")
    of = lambda x: comp.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = saved(components(between), f"merged-{turn}")
    up = merged.select(F.col("id").alias("component"), F.col("component").alias("top"))
    old = comp.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    new = merged.join(comp.select("id"), "id", "left_anti")
    return saved(old.unionByName(new), f"components-{turn}")


def _open(candidates: DataFrame, comp: DataFrame) -> DataFrame:
    """Members, with their components, of the buckets that hold more than one component."""
    now = candidates.join(comp, "id", "left").select("bucket", "id", "met", F.coalesce("component", "id").alias("component"))
    return now.join(now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket"), "bucket")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (least id with the same set), component_id, kept."""
    # mark tells the texts of one id apart, so that keys, sketches and sets all come from the one chosen here
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    every = saved(_sets(slim, size, False, False).select("doc_id", "mark", "n", "key"), "shingle-keys")
    rows = every.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("n", "key", "mark")).alias("s")).select("doc_id", "s.n", "s.key", "s.mark")
    classes = saved(rows.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("doc_id").alias("id"), "mark")).alias("at"), F.max("n").alias("n")).select("key", "n", "at.*"), "shingle-classes")
    # texts meet the ids wanted in one exchange; rows that repeat both id and text, if any, are first cut to one
    parts = partitions(docs, 4)
    twice = every.where("doc_id is not null").groupBy("doc_id", "mark").agg(F.count("*").alias("k")).where("k > 1")
    texts = slim if twice.isEmpty() else slim.dropDuplicates(["doc_id", "mark"])
    texts = texts.repartition(parts, "doc_id", "mark")

    def texts_of(wanted: DataFrame) -> DataFrame:
        return texts.join(wanted.select(F.col("id").alias("doc_id"), "mark").repartition(parts, "doc_id", "mark"), ["doc_id", "mark"], "left_semi")

    # sketches and sets of one document for each class
    sk = saved(_sets(texts_of(classes), size, False, True).select(F.col("doc_id").alias("id"), "n", "sketch"), "sketches")
    buckets = saved(_buckets(sk), "buckets")
    shared = buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "bucket")
    met = shared.groupBy("id").agg(F.sum("m").alias("met"))
    candidates = saved(shared.join(met, "id").select("bucket", "id", "met"), "candidates")
    in_any = candidates.select("id").distinct()

    def small(batches):
        for batch in batches:
            m = batch.num_rows
            if m:
                s = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(m, T).astype("<u2")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in s], pa.binary())], ["id", "small"])

    sketches = saved(sk.join(in_any, "id", "left_semi").select("id", "sketch").mapInArrow(small, "id long, small binary"), "small-sketches")
    sets = saved(_sets(texts_of(classes.join(in_any, "id")), size, True, False).select(F.col("doc_id").alias("id"), "ids"), "sets")
    share = percent / 100
    least = share - SLACK * (share * (1 - share) / T) ** 0.5

    # hub rounds: each member against the member of its bucket that meets most others, first of all, then of the other components
    comp = None
    for turn in range(2):
        if comp is None:
            hubs = candidates.groupBy("bucket").agg(F.max(F.struct("met", F.expr("-id").alias("k"))).alias("h")).select("bucket", F.expr("-h.k").alias("hub"), F.col("h.met").alias("hub_met"))
            pairs = candidates.join(hubs, "bucket").where("id <> hub")
        else:
            now = _open(candidates, comp)
            main = now.groupBy("bucket").agg(F.min("component").alias("main"))
            hubs = now.join(main, "bucket").where("component <> main").groupBy("bucket").agg(F.max(F.struct("met", F.expr("-id").alias("k"), "component")).alias("h")).select("bucket", F.expr("-h.k").alias("hub"), F.col("h.met").alias("hub_met"), F.col("h.component").alias("hc"))
            pairs = now.join(hubs, "bucket").where("component <> hc")
        # one hub a member, the one that meets most; whatever that leaves apart is settled below
        pairs = pairs.groupBy("id").agg(F.max(F.struct("hub_met", "hub")).alias("h")).select(F.least("id", "h.hub").alias("a"), F.greatest("id", "h.hub").alias("b")).distinct()
        found = saved(_verified(saved(_agreement(pairs, sketches, least), f"likely-{turn}"), sets, percent), f"links-{turn}")
        if comp is None or not found.isEmpty():
            comp = _merged(comp, found, turn)

    # the exact rest: full sets of a bucket in different components
    rest = saved(_open(candidates, comp).join(sk.select("id", "n"), "id").select("bucket", "id", "n", "component"), "open-buckets")
    found = saved(_links_in_buckets(rest, sets, percent), "links-rest")
    if not found.isEmpty():
        comp = _merged(comp, found, 9)

    # written, so that the join below is not tied to the partitions of the classes and a key of many copies can be split
    by_class = saved(classes.join(comp, classes.id == comp.id, "left").select("key", F.col("component"), classes.id.alias("class_id")), "classes")
    out = rows.join(by_class, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "class_id", "doc_id").alias("component_id"))
    unnamed = every.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(unnamed).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
