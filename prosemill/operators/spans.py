"""Spans by their numbers: places from lengths, the collapse of overlaps A3 and the claiming of territory A9.

Texts are matched by Spark; what is left is sums and comparisons of whole numbers, made here for all rows of an Arrow
batch at once: spans lie one after another in flat arrays, beside the number of their row. Only spans that overlap one
before them are walked through one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start: int, stop: int, n: int>"
ITEM = "struct<start: int, neg: int, rule_ord: int, doc_level: boolean, n: int>"
#: What is told besides of spans and items where their places are wanted.
SPAN_PLACE = ", line: int, col: int>"
ITEM_PLACE = ", line: int, col: int, end_line: int, end_col: int, sentence: int, ends: int>"
SPOT = "struct<start: int, stop: int, priority: int>"


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The length of each list, 0 for null, and the items of all."""
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def _numbers(items: pa.Array) -> np.ndarray:
    return items.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(sizes: np.ndarray, items: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), items)


def _structs(**fields) -> pa.StructArray:
    columns = [x if isinstance(x, pa.Array) else pa.array(x, pa.bool_() if x.dtype == bool else pa.int32()) for x in fields.values()]
    return pa.StructArray.from_arrays(columns, names=list(fields))


def free(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which spans, in the order of their rows and starts, begin at or behind the end of the last one kept of their row."""
    kept = np.ones(len(row), bool)
    if len(row) < 2:
        return kept
    base = row * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(base + stop)
    clash = np.flatnonzero((base + start)[1:] < reach[:-1]) + 1
    last = at = -1
    for i, a, b, before in zip(clash.tolist(), start[clash].tolist(), stop[clash].tolist(), stop[clash - 1].tolist(), strict=True):
        # a span without a clash is kept, so a run of clashes starts from the one before it
        if i - 1 != last:
            at = before
        if a < at:
            kept[i] = False
        else:
            at = b
        last = i
    return kept


def _breaks(row: np.ndarray, offset: np.ndarray, pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of offsets in their rows: the breaks before each, the last of them (or -1), and the first one at or behind it (or the text's end).

    pieces: by row the lengths of what lies between the breaks of its text.
    """
    sizes, n = _flat(pieces)
    first, ends = np.cumsum(sizes) - sizes, np.concatenate([[0], np.cumsum(_numbers(n) + 1)])
    at = ends[1:] - 1 - np.repeat(ends[first], sizes)
    width = max(int(at.max(initial=0)), int(offset.max(initial=0))) + 1
    i = np.searchsorted(np.repeat(np.arange(len(sizes)), sizes) * width + at, row * width + offset)
    at = np.append(at, 0)
    return i - first[row], np.where(i > first[row], at[i - 1], -1), at[i]


def found(lengths: Column, gaps: Column, others: Column, fires: Column, counts: Column, word: Column, doc_level: list[bool], with_spans: bool, breaks: Column | None = None) -> Column:
    """A2 A3: struct<spans, kept> of a row, or of kept alone.

    By rule: lengths and gaps, array<array<int>> of the matches and of what lies before each; others, array<array<SPAN>>
    of rules whose places are known; fires, array<boolean>; counts, array<int>. word: struct<start, stop> of the first word, at
    which a rule of the document without a match points. breaks: struct<lines, terms>, array<int> of the lengths between
    newlines and between terminators, if lines, columns and the bounds of sentences (X9, X10) are wanted.
    """
    many = len(doc_level)
    span, item = (SPAN, ITEM) if breaks is None else (SPAN[:-1] + SPAN_PLACE, ITEM[:-1] + ITEM_PLACE)
    kind = f"struct<{f'spans: array<array<{span}>>, ' if with_spans else ''}kept: array<{item}>>"

    @F.arrow_udf(kind)
    def made(lengths: pa.Array, gaps: pa.Array, others: pa.Array, fires: pa.Array, counts: pa.Array, word: pa.Array, *breaks: pa.Array) -> pa.Array:
        rows = len(lengths)

        def places(row: np.ndarray, offset: np.ndarray) -> dict:
            line, last, _ = _breaks(row, offset, breaks[0].field("lines"))
            return {"line": line + 1, "col": offset - last}


        sizes, n = _flat(lengths.flatten())
        n = _numbers(n)
        ends = np.concatenate([[0], np.cumsum(_numbers(_flat(gaps.flatten())[1]) + n)])
        stop = ends[1:] - np.repeat(ends[np.cumsum(sizes) - sizes], sizes)
        start, count = stop - n, pa.nulls(len(n), pa.int32())
        more, known = _flat(others.flatten())
        if len(known):
            owner = np.concatenate([np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(sizes)), more)])
            order = np.argsort(owner, kind="stable")
            start, stop = (np.concatenate([x, _numbers(known.field(f))])[order] for x, f in ((start, "start"), (stop, "stop")))
            count, sizes = pa.concat_arrays([count, known.field("n").cast(pa.int32())]).take(pa.array(order)), sizes + more
        told, whole = fires.flatten().fill_null(False).to_numpy(zero_copy_only=False).astype(bool), np.tile(np.array(doc_level, bool), rows)

        each = np.flatnonzero(np.repeat(told & ~whole, sizes))
        owner = np.repeat(np.arange(len(sizes)), sizes)[each]
        # a rule of the document points at its first match, at the first word, or at the start
        docs = np.flatnonzero(told & whole)
        none = sizes[docs] == 0
        at = np.where(none, 0, (np.cumsum(sizes) - sizes)[docs])
        first = [np.maximum(_numbers(word.field(f)), 0)[docs // many] for f in ("start", "stop")]
        wordless = _numbers(word.field("start"))[docs // many] < 0
        anchors = [np.where(none, np.where(wordless, 0, w), np.append(x, 0)[at]) for w, x in zip(first, (start, stop), strict=True)]
        owner = np.concatenate([owner, docs])
        a, b = np.concatenate([start[each], anchors[0]]), np.concatenate([stop[each], anchors[1]])
        numbers = pa.concat_arrays([count.take(pa.array(each)), counts.flatten().take(pa.array(docs))])
        level = np.arange(len(owner)) >= len(each)

        order = np.lexsort((owner % many, -b, a, owner // many))
        row, spans = (owner // many)[order], ~level[order]
        keep = np.ones(len(order), bool)
        keep[spans] = free(row[spans], a[order][spans], b[order][spans])
        order, row, told = order[keep], row[keep], {}
        if breaks:
            terms = breaks[0].field("terms")
            told = places(row, a[order]) | {f"end_{k}": x for k, x in places(row, b[order]).items()} | {"sentence": _breaks(row, a[order], terms)[1] + 1, "ends": _breaks(row, b[order], terms)[2]}
        kept = _lists(np.bincount(row, minlength=rows), _structs(start=a[order], neg=-b[order], rule_ord=owner[order] % many, doc_level=level[order], n=numbers.take(pa.array(order)), **told))
        if not with_spans:
            return pa.StructArray.from_arrays([kept], names=["kept"])
        spans = _lists(np.full(rows, many), _lists(sizes, _structs(start=start, stop=stop, n=count, **(places(np.repeat(np.arange(len(sizes)), sizes) // many, start) if breaks else {}))))
        return pa.StructArray.from_arrays([spans, kept], names=["spans", "kept"])

    return made(lengths, gaps, others, fires, counts, word, *([] if breaks is None else [breaks]))


def claimed(ranges: Column, priorities: int) -> Column:
    """Of array<struct<priority, start, stop>> those that overlap nothing kept before, as array<SPOT> in reading order.

    A level's ranges are held against what is kept, which is in order and free of overlaps: against the ends of those that
    begin before or with them, and against the next one that begins behind. What passes is made free of itself.
    """

    @F.arrow_udf(f"array<{SPOT}>")
    def made(ranges: pa.Array) -> pa.Array:
        sizes, items = _flat(ranges)
        row = np.repeat(np.arange(len(sizes)), sizes)
        start, stop, priority = (_numbers(items.field(f)) for f in ("start", "stop", "priority"))
        base = row * (int(stop.max(initial=0)) + 1)
        held = np.zeros(0, np.int64)
        ordered = lambda x: x[np.lexsort((priority[x], -stop[x], start[x], row[x]))]
        for p in range(priorities):
            mine = ordered(np.flatnonzero(priority == p))
            if len(held):
                begins, reach = (base + start)[held], np.maximum.accumulate((base + stop)[held])
                behind = np.searchsorted(begins, (base + start)[mine], "right")
                mine = mine[(np.append(reach, -1)[behind - 1] <= (base + start)[mine]) & (np.append(begins, np.iinfo(np.int64).max)[behind] >= (base + stop)[mine])]
            held = ordered(np.concatenate([held, mine[free(row[mine], start[mine], stop[mine])]]))
        return _lists(np.bincount(row[held], minlength=len(sizes)), _structs(start=start[held], stop=stop[held], priority=priority[held]))

    return made(ranges)
