"""Exact removal of repeated byte strings, by column-wise multi-document suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts anywhere
else in the collection, the same document included.

1. Segments. Each window of `length` bytes is assigned to its minimiser, the
   least hash among its GRAM-byte grams (leftmost on ties). Equal windows have
   equal minimisers at equal places, so windows can only repeat among the
   segments (runs of windows) that share a minimiser; one that occurs once is
   done with.
2. Columns. The distinct segments of a minimiser, aligned at it, are the
   documents of a column-wise construction: every round inserts one symbol of
   each document, from the last column to the first, and updates the sorted
   order of all suffixes of the column (the column's part of the collection's
   Burrows-Wheeler transform, the symbols before them being the next column) and
   the common prefixes of neighbours. A window repeats if its common prefix with
   a neighbour reaches `length`, or its segment occurs more than once.
   Input and output of the rounds are sequential files (shuffle blocks); a task
   holds a bounded block of segments.
3. A minimiser with more than HOT distinct segments (the edge of a passage in
   very many documents) would make one task grow: its windows are spread out and
   counted one by one by a 128-bit hash.
4. Spans go back to their documents.

Defined results: null text is empty; texts shorter than `length` lose nothing;
repeated rows repeat every string; null ids are kept as null; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, held, saved, text_blocks

GRAM, HOT, BLOCK = 24, 50_000, 4096
PLACE = "doc_id long, mark long"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def segments(raws: list[bytes], length: int, hasher: Hasher):
    """Of the texts: (text number, minimiser hash, segment hash, first window, further windows, minimiser's place in the segment)."""
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    n = int(offsets[-1])
    gram = min(GRAM, length)
    none = np.zeros(0, np.int64)
    if n < length or not (sizes >= length).any():
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    x = np.frombuffer(b"".join(raws), np.uint8)
    up, down = hasher.powers(n + 1)
    with np.errstate(over="ignore"):
        p = np.empty(n + 1, np.uint64)
        p[0] = 0
        np.cumsum(hasher.values[x] * up[:n], out=p[1:])
        g = _mixed((p[gram:] - p[: n - gram + 1]) * down[: n - gram + 1])
        key = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
        width, have = length - gram + 1, 1
        low = key
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edge = np.zeros(n + 2, np.int8)
        long = sizes >= length
        edge[offsets[:-1][long]] += 1
        edge[(offsets[1:] - length + 1)[long]] -= 1
        at = np.flatnonzero(np.cumsum(edge)[: len(place)])
        a = place[at]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)])
        lo = at[new]
        hi = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
        a = a[new]
        end = hi + length
        seg = _mixed((p[end] - p[lo]) * down[lo] + ((a - lo) * 4096 + (end - lo)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    doc = np.searchsorted(offsets, lo, "right") - 1
    return doc, g[a], seg, lo - offsets[doc], hi - lo, a - lo


def repeated_windows(strings: list[bytes], groups: np.ndarray, offs: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Column-wise construction over aligned strings: [string, k] tells if the window at offset k repeats.

    groups: non-decreasing group numbers; offs: the place of the minimiser, at which strings are aligned.
    """
    n = len(strings)
    size = np.fromiter(map(len, strings), np.int64, n)
    top = int(offs.max())
    start = top - offs
    last = start + size - 1
    width = int(last.max()) + 1
    flat = np.frombuffer(b"".join(strings), np.uint8)
    sym = np.zeros((width, n), np.uint8)
    rows = np.repeat(np.arange(n), size)
    inside = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    sym[inside + start[rows], rows] = flat
    out = np.zeros((width, n), bool)
    by_last = np.argsort(last, kind="stable")
    cut_last = np.searchsorted(last[by_last], np.arange(width + 1))
    gone_at = np.bincount(start, minlength=width + 1) > 0
    order, lcp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for col in range(width - 1, -1, -1):
        if col + 1 <= width - 1 and gone_at[col + 1] and len(order):
            # documents that have no more symbols leave; their neighbours' common prefix is the least over the gap
            stay = np.flatnonzero(start[order] <= col)
            if len(stay) < len(order):
                if len(stay):
                    from_ = np.concatenate([[0], stay[:-1] + 1])
                    lcp = np.minimum.reduceat(lcp, from_)[: len(stay)] if stay[-1] == len(order) - 1 else np.minimum.reduceat(lcp[: stay[-1] + 1], from_)
                else:
                    lcp = lcp[:0]
                order = order[stay]
        fresh = by_last[cut_last[col] : cut_last[col + 1]]
        if len(fresh):
            order = np.concatenate([np.sort(fresh), order])
            lcp = np.concatenate([np.zeros(len(fresh), np.int64), lcp])
            perm = np.argsort(groups[order], kind="stable")
            order, lcp = order[perm], lcp[perm]
        if not len(order):
            continue
        key = groups[order] * 256 + sym[col, order]
        perm = np.argsort(key, kind="stable")
        key = key[perm]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        new = np.zeros(len(order), np.int64)
        if len(same):
            pairs = np.empty(2 * len(same), np.int64)
            pairs[::2], pairs[1::2] = perm[same - 1] + 1, perm[same] + 1
            new[same] = np.minimum.reduceat(np.append(lcp, 0), pairs)[::2] + 1
        order, lcp = order[perm], new
        hit = lcp >= length
        if hit.any():
            hit[:-1] |= hit[1:]
            out[col, order[hit]] = True
    cells = np.arange(int((size - length).max()) + 1)
    ok = cells[None, :] <= (size - length)[:, None]
    took = out[np.minimum(start[:, None] + cells[None, :], width - 1), np.arange(n)[:, None]]
    return (took | (counts > 1)[:, None]) & ok


def _runs(row: np.ndarray) -> list[int]:
    """[first, last, first, last ...] of the runs of True."""
    d = np.flatnonzero(np.diff(np.concatenate([[False], row, [False]]).astype(np.int8)))
    d[1::2] -= 1
    return d.tolist()


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and, with_text, the kept bytes)."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # (doc_id, mark) tells rows apart; equal rows repeat each other anyway
    text = text.withColumn("mark", F.xxhash64("text"))

    def find(batches):
        hasher = held("hasher", Hasher)
        for batch in batches:
            for first, raws in text_blocks(batch, 1):
                doc, h, seg, lo, more, off = segments(raws, length, hasher)
                if len(doc):
                    take = pa.array(first + doc)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(seg.view(np.int64)), batch.column(0).take(take), batch.column(2).take(take), *(pa.array(v.astype(np.int64)) for v in (lo, more, off))], ["hash", "seg", "doc_id", "mark", "lo", "more", "off"])

    occ = saved(text.mapInArrow(find, f"hash long, seg long, {PLACE}, lo long, more long, off long"), "segments")
    # written out, so that the join shuffles both sides and a hot minimiser's partition can be split
    twice = saved(occ.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1").select("hash"), "repeated-minimisers")
    occ = saved(occ.join(twice, "hash"), "shared-segments")
    distinct = occ.groupBy("hash", "seg").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "lo", "more", "off")).alias("at"))
    distinct = saved(distinct.select("hash", "seg", "n", "at.*"), "distinct-segments")
    kinds = distinct.groupBy("hash").agg(F.count("*").alias("kinds"))
    chosen = distinct.join(kinds, "hash").withColumn("hot", F.col("kinds") > HOT)
    per_doc = chosen.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("hash", "seg", "n", "lo", "more", "off", "hot")).alias("list"))
    same = lambda a, b: [F.col(f"{a}.mark") == F.col(f"{b}.mark"), F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))]
    with_list = text.alias("t").join(per_doc.alias("p"), same("t", "p")).select("t.text", "p.list")

    def cut(batches):
        """Bytes of the segments; of hot ones a hash of each window in place of them."""
        import xxhash

        for batch in batches:
            rows = {c: [] for c in ("hash", "seg", "n", "off", "k", "key", "bytes")}

            def put(*values, rows=rows):
                for c, v in zip(rows, values, strict=True):
                    rows[c].append(v)

            for t, items in zip(batch.column(0), batch.column(1), strict=True):
                raw, done = t.as_py().encode("utf-8", "surrogatepass"), set()
                for s in items.as_py():
                    if (s["hash"], s["seg"]) in done:  # repeated rows name a segment once each
                        continue
                    done.add((s["hash"], s["seg"]))
                    if s["hot"]:
                        for k in range(s["more"] + 1):
                            put(s["hash"], s["seg"], s["n"], s["off"], k, xxhash.xxh3_128_digest(raw[s["lo"] + k : s["lo"] + k + length]), None)
                    else:
                        put(s["hash"], s["seg"], s["n"], s["off"], None, None, raw[s["lo"] : s["lo"] + s["more"] + length])
            kinds = [pa.int64()] * 5 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], list(rows))

    pieces = with_list.mapInArrow(cut, "hash long, seg long, n long, off long, k long, key binary, bytes binary")

    def columns(batches):
        def solve(rows):
            hashes = np.array([r[0] for r in rows])
            groups = np.cumsum(np.concatenate([[0], (hashes[1:] != hashes[:-1]).astype(np.int64)]))
            hit = repeated_windows([r[4] for r in rows], groups, np.array([r[3] for r in rows]), np.array([r[2] for r in rows]), length)
            found = [(r[0], r[1], _runs(h)) for r, h in zip(rows, hit, strict=True) if h.any()]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.int64()))], ["hash", "seg", "runs"])

        wait: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if len(wait) >= BLOCK and row[0] != wait[-1][0]:
                    yield solve(wait)
                    wait = []
                wait.append(row)
        if wait:
            yield solve(wait)

    flag_schema = "hash long, seg long, runs array<long>"
    cold = pieces.where("bytes is not null").select("hash", "seg", "n", "off", "bytes").repartition("hash").sortWithinPartitions("hash").mapInArrow(columns, flag_schema)
    windows = pieces.where("key is not null").select("hash", "seg", "n", "k", "key")
    often = windows.groupBy("key").agg(F.sum("n").alias("c")).where("c > 1").select("key")
    hot = windows.join(often, "key").select("hash", "seg", F.array("k", "k").alias("runs"))
    # rows that repeat both id and text name a segment once each: of equal flags and spans one is enough
    flags = saved(cold.unionByName(hot).distinct(), "repeated-windows")
    spans = occ.join(flags, ["hash", "seg"]).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("lo", "runs")).alias("spans"))
    last = text.alias("t").join(spans.alias("p"), same("t", "p"), "left").select("t.doc_id", "t.text", "p.spans")

    def finish(batches):
        for batch in batches:
            rows = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for t, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                kept, n_spans = raw, 0
                if spans.is_valid:
                    edge = np.zeros(len(raw) + 1, np.int64)
                    for s in spans.as_py():
                        r = np.array(s["runs"], np.int64) + s["lo"]
                        np.add.at(edge, r[::2], 1)
                        np.add.at(edge, r[1::2] + length, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    n_spans = len(_runs(gone)) // 2
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for c, v in zip(rows, (len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                    rows[c].append(v)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True))], ["doc_id", *rows])

    out = last.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
