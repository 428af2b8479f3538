"""Prose from markup (X1-X8), as Arrow-batched functions.

HTML goes through the standard library's tokenizer; Markdown through a line
machine. Every extractor returns the text and its runs (o, s, n, fixed): n
characters of the text from o on come from the source from s on, or all from the
one place s if fixed. extracted() gives both for a table of sources.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import accumulate, chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements without prose, and elements that break lines.
SKIP = set("script style pre code kbd samp var tt svg math textarea template noscript iframe object canvas head".split())
BLOCK = set("address article aside blockquote br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p section summary table tbody td tfoot th thead tr ul".split())


class _Runs:
    """A text under construction, with where its parts come from."""

    def __init__(self):
        self.parts: list[str] = []
        self.runs: list[tuple[int, int, int, bool]] = []
        self.length = 0

    def put(self, text: str, at: int, fixed: bool = False) -> None:
        if not text:
            return
        self.parts.append(text)
        self.runs.append((self.length, at, len(text), fixed))
        self.length += len(text)


class _Html(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=False)
        self.out = _Runs()
        self.depth, self.ignored = 0, False
        self.lines = [0]
        for m in re.finditer("\n", source):
            self.lines.append(m.end())

    def put(self, text: str, at: int, fixed: bool) -> None:
        if not self.depth and not self.ignored:
            self.out.put(text, at, fixed)

    def here(self) -> int:
        line, col = self.getpos()
        return self.lines[line - 1] + col

    def brk(self) -> None:
        if self.out.parts and not self.out.parts[-1].endswith("\n"):
            self.put("\n", self.here(), True)

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.depth += 1
        elif tag in BLOCK:
            self.brk()

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self.brk()

    def handle_endtag(self, tag):
        if tag in SKIP:
            self.depth = max(0, self.depth - 1)
        elif tag in BLOCK:
            self.brk()

    def handle_data(self, data):
        at, last = self.here(), 0
        for m in re.finditer(r"[ \t\r\n\f]*\n[ \t\r\n\f]*|[ \t]{2,}", data):
            self.put(data[last : m.start()], at + last, False)
            self.put(" ", at + m.start(), True)
            last = m.end()
        self.put(data[last:], at + last, False)

    def handle_entityref(self, name):
        import html

        text = {"shy": "", "zwnj": "", "zwj": ""}.get(name, html.unescape(f"&{name};"))
        self.put(text, self.here(), True)

    def handle_charref(self, name):
        import html

        self.put(html.unescape(f"&#{name};"), self.here(), True)

    def handle_comment(self, data):
        word = data.strip().lower()
        if word in ("prose-ignore-start", "prose-ignore"):
            self.ignored = True
        elif word == "prose-ignore-end":
            self.ignored = False


def extract_html(source: str) -> tuple[str, list[tuple[int, int, int, bool]]]:
    p = _Html(source)
    p.feed(source)
    p.close()
    return wrapped("".join(p.out.parts), p.out.runs)


# What counts as a token inside a line and as a kind of line.
INLINE = re.compile(
    r"(?P<ticks>`+)(?P<code>.*?)(?P=ticks)"
    r"|!?\[(?P<link>(?:[^\[\]]|\[[^\]]*\])*)\](?:\((?:[^()\\]|\\.|\([^)]*\))*\)|\[[^\]]*\])"
    r"|\[\^[^\]]+\]|<(?:https?|mailto|ftp):[^>\s]*>|</?[a-zA-Z][^>]*>|(?:https?://|www\.)[^\s<>()\[\]\"']+"
    r"|\*{1,3}|~~|={2,}|(?<![A-Za-z0-9])_{1,3}|_{1,3}(?![A-Za-z0-9])",
    re.S,
)
FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})(.*)")
QUOTE, HEADING, ITEM = (re.compile(p) for p in (r"\s*(?:>\s?)+", r"\s{0,3}#{1,6}\s+", r"\s*(?:[-*+]|\d{1,9}[.)])\s+"))
NO_PROSE = re.compile(r"\s{0,3}(?:\[[^\]]+\]:\s*\S.*|(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,}|=+\s*|-{2,}\s*)|\s*\|?[\s:|-]*-[\s:|-]*\|[\s:|-]*")
ROW = re.compile(r"\s*\|.*\|\s*")
IGNORE = re.compile(r"\s*<!--\s*prose-ignore-(start|end)\s*-->\s*", re.I)
SHORT_CODE = 24


def _kept(line: str, a: int, b: int, depth: int = 0):
    """(start, stop) of the pieces of line[a:b] that are words: not markup, long code, addresses or footnotes."""
    at = a
    for m in INLINE.finditer(line, a, b):
        if m.start() < at:
            continue
        start, stop = m.span()
        inner = None
        if m["ticks"]:
            code = m["code"].strip()
            if code and len(code) <= SHORT_CODE and not re.search(r"\s", code):
                low = m.start("code") + m["code"].index(code)
                inner = [(low, low + len(code))]
        elif m["link"]:
            inner = _kept(line, *m.span("link"), depth + 1) if depth < 3 else [m.span("link")]
        if inner is None and line[max(0, start - 1) : start] + line[stop : stop + 1] in ("()", "[]") and start > at and stop < b:
            start, stop = start - 1, stop + 1  # nothing is left between the brackets
        yield at, start
        yield from inner or ()
        at = stop
    yield at, b


def _open_ticks(line: str, a: int) -> tuple[int, int] | None:
    """Place and length of the first run of backticks after a that nothing on the line closes."""
    runs = [(m.start(), len(m[0])) for m in re.compile("`+").finditer(line, a)]
    while runs:
        place, size = runs.pop(0)
        close = next((k for k, r in enumerate(runs) if r[1] == size), None)
        if close is None:
            return place, size
        runs = runs[close + 1 :]
    return None


def extract_markdown(source: str, skip_tables: bool = False, indented_code: bool = True) -> tuple[str, list[tuple[int, int, int, bool]]]:
    """Prose of a Markdown document; wrapped lines are joined, headings, items, rows and hard breaks end lines."""
    out, at = _Runs(), 0
    lines = []
    for raw in source.split("\n"):
        lines.append((at, raw.removesuffix("\r")))
        at += len(raw) + 1
    first = lines[0][1].strip()
    if first in ("---", "+++"):
        lines = lines[next((k + 1 for k in range(1, len(lines)) if lines[k][1].strip() == first), 0) :]
    fence, ignored, near_list, open_, ended, ticks = "", False, 0, False, True, 0

    def close(place: int) -> None:
        nonlocal open_
        if open_:
            out.put("\n", place, True)
        open_ = False

    for place, line in lines:
        mark = None if fence else IGNORE.fullmatch(line)
        if mark:
            ignored = mark[1].lower() == "start"
        f = FENCE.fullmatch(line)
        if mark or ignored:
            close(place)
        elif fence:
            if f and f[1].startswith(fence) and not f[2].strip():
                fence = ""
            close(place)
        elif f and not (f[1][0] == "`" and "`" in f[2]):
            fence, ticks = f[1], 0
            close(place)
        elif not line.strip():
            ticks = 0
            close(place)
        elif (indented_code and not near_list and line.startswith(("    ", "\t"))) or NO_PROSE.fullmatch(line) or (skip_tables and ROW.fullmatch(line)):
            close(place)
        else:
            near_list = 3 if ITEM.match(line) else max(0, near_list - 1)
            quote = QUOTE.match(line)
            low = bare = quote.end() if quote else 0
            for prefix in (HEADING, ITEM):
                m = prefix.match(line, low)
                low = m.end() if m else low
            row = bool(ROW.fullmatch(line))
            block = row or bool(HEADING.match(line, bare))
            if open_:
                out.put("\n" if block or ended or ITEM.match(line, bare) else " ", place, True)
            body = line.replace("|", " ") if row else line
            if ticks:  # inside a code span from an earlier line
                m = re.compile(f"(?<!`)`{{{ticks}}}(?!`)").search(body, low)
                if not m:
                    if open_:
                        out.put(" ", place, True)
                    continue
                low, ticks = m.end(), 0
            unclosed = _open_ticks(body, low)
            high = unclosed[0] if unclosed else len(body)
            ticks = unclosed[1] if unclosed else 0
            for a, b in _kept(body, low, high):
                out.put(body[a:b], place + a)
            open_, ended = True, block or line.endswith(("  ", "\\"))
    close(len(source))
    return wrapped("".join(out.parts), out.runs)


def extract_plain(source: str) -> tuple[str, list[tuple[int, int, int, bool]]]:
    """The text itself, long lines broken."""
    return wrapped(source, [(0, 0, len(source), False)] if source else [])


def wrapped(text: str, runs: list[tuple[int, int, int, bool]], width: int = 2000) -> tuple[str, list[tuple[int, int, int, bool]]]:
    """Text and runs with lines of at most `width` characters: a line break goes in before the last blank, or where the line is full."""
    breaks, start = [], 0
    for line in text.split("\n"):
        low, end = start, start + len(line)
        while end - low > width:
            cut = max(text.rfind(" ", low + 1, low + width), text.rfind("\t", low + 1, low + width))
            low = cut if cut > 0 else low + width
            breaks.append(low)
        start = end + 1
    if not breaks:
        return text, runs
    out, k = _Runs(), 0
    for o, s, n, fixed in runs:
        at = o
        while k < len(breaks) and breaks[k] < o + n:
            out.put(text[at : breaks[k]], s if fixed else s + at - o, fixed)
            at = breaks[k]
            out.put("\n", s if fixed else s + at - o, True)
            k += 1
        out.put(text[at : o + n], s if fixed else s + at - o, fixed)
    return "".join(out.parts), out.runs


def to_source(runs: list[tuple[int, int, int, bool]], offset: int) -> int:
    """The source offset of a text offset; past the end, the end of the last run."""
    import bisect

    if not runs:
        return 0
    o, s, n, fixed = runs[max(0, bisect.bisect_right([r[0] for r in runs], offset) - 1)]
    return s if fixed else s + min(offset - o, n)


EXTRACT = {"html": extract_html, "md": extract_markdown, "txt": extract_plain}


@F.pandas_udf(StringType())
def html_text(source: pd.Series) -> pd.Series:
    return source.map(lambda x: None if x is None else extract_html(x)[0])


@F.pandas_udf(StringType())
def prose_text(source: pd.Series, kind: pd.Series) -> pd.Series:
    """The text by kind."""
    return pd.Series([None if s is None else EXTRACT.get(k, extract_plain)(s)[0] for s, k in zip(source, kind, strict=True)])


def portions(batch, column: int, most: int = 1 << 20):
    """A batch in slices of at most `most` bytes of a text column, a row at least: runs take many times the space of their source."""
    import pyarrow.compute as pc

    begin = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > begin and size + n > most:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    yield batch.slice(begin)


def extracted(docs: DataFrame) -> DataFrame:
    """Docs (with src and kind) with text and runs; a null source is empty."""
    import pyarrow as pa

    runs_type = pa.list_(pa.struct([("o", pa.int32()), ("s", pa.int32()), ("n", pa.int32()), ("fixed", pa.bool_())]))
    names = docs.columns

    def run(batches):
        for whole in batches:
            for batch in portions(whole, names.index("src")):
                got = [EXTRACT.get(k, extract_plain)((s or "").removeprefix("\ufeff")) for s, k in zip(batch.column(names.index("src")).to_pylist(), batch.column(names.index("kind")).to_pylist(), strict=True)]
                ends = [0, *accumulate(len(r) for _, r in got)]
                columns = list(zip(*chain.from_iterable(r for _, r in got), strict=True)) or [()] * 4
                runs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, runs_type.value_type, strict=True)], fields=list(runs_type.value_type))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t for t, _ in got], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)], [*names, "text", "runs"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{own}, text string, runs array<struct<o: int, s: int, n: int, fixed: boolean>>")
