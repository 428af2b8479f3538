"""Tokenizers, sentence splitters and the translation of rule patterns.

Offsets are code points, 0-based, ends exclusive.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .needles import begins_of

# Classes that must agree with the rule dialect.
RATE_WORD = r"[A-Za-z0-9][A-Za-z0-9'’-]*"
ECHO_WORD = r"[a-z0-9'’-]+"
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# SPACE outside a class: letters of ASCII fail after three tests, not after ten
BLANK = r"[\t-\r\x{20}[\x{80}-\x{10FFFF}&&" + SPACE.replace(r"\s", "") + "]]"
# a match can only start where a run of other characters does, so long lines without a terminator stay linear
RUN_START = r"(?:(?<![^.!?\n])|\G)"
SENTENCE = {"echo": r"[^.!?\n]++[.!?]?", "anaphora": RUN_START + r"[^.!?\n]++[.!?]", "frame": RUN_START + r"[^.!?\n]*+[.!?]++"}

# The closed-class words of the prose gate and of sentence frames.
FUNCTION_WORDS = (
    "a an the of in on at to for with by from as and or but nor so yet "
    "is was are were be been being has have had do does did will would can could may might must shall should "
    "that which who whom whose this these those it its their his her our your my "
    "not no if then than when where while because although though after before during over under between "
    "i we you he she they them us him me one two three there here about into through out up down off "
    "s t re ve ll d m"
).split()

# Openers that do not make an anaphora.
COMMON_OPENERS = "i it the a an this that we you they he she there but and so in as if my his her their its these those for at on of to is was".split()

# English function words of the corpus filter.
ENGLISH = (
    "the of and to a in that is was for it with as be on by at this from or an are "
    "but not have has had which they you we he she their our its will would can could should there "
    "been being do does did if then than when what who how all any some no more most other into over"
).split()


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    """A rule's pattern for java.util.regex: ASCII word boundaries, wide white space, bounded look-behinds, literal class marks."""
    out, i, in_class, depth = [], 0, False, 0
    behind: list[int] = []
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            d = pattern[i + 1]
            if d == "b" and not in_class:
                out.append("(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")
            elif d == "s":
                out.append(SPACE[1:-1] if in_class else BLANK)
            elif d == "S" and not in_class:
                out.append("[^" + SPACE[1:])
            else:
                out.append(c + d)
            i += 2
            if behind and not in_class and d == "s" and pattern[i : i + 1] in ("+", "*"):
                out.append("{1,8}" if pattern[i] == "+" else "{0,8}")
                i += 1
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c == "[" or pattern.startswith("&&", i):
                out.append("\\")
        elif c == "[":
            in_class = True
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            continue
        elif c == "(":
            depth += 1
            if pattern.startswith(("(?<!", "(?<="), i):
                behind.append(depth)
        elif c == ")":
            if behind and behind[-1] == depth:
                behind.pop()
            depth -= 1
        elif c == "$":
            out.append(r"\z")
            i += 1
            continue
        out.append(c)
        i += 1
    return ("(?i)" if ignore_case else "") + _start(pattern, "".join(out))


def _start(pattern: str, java: str) -> str:
    """The translated pattern behind a look-ahead for what its matches begin with, which most places of a text fail at once."""
    known = begins_of(pattern) if re.search(r"[(|]|\\[bs]", pattern) else None
    if known is None:
        return java
    ranges, at_word = known
    # single characters of ASCII share one table in the engine; the others are asked after one comparison
    low = "".join(f"\\x{{{c:X}}}" for a, b in ranges for c in range(a, min(b, 127) + 1))
    high = "".join(f"\\x{{{max(a, 128):X}}}-\\x{{{b:X}}}" for a, b in ranges if b >= 128)
    rest = f"[\\x{{80}}-\\x{{10FFFF}}&&[{high}]]" if high else ""
    return f"(?=[{low}{rest}]){'(?<![A-Za-z0-9_])' if at_word else ''}(?:{java})"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words_of(text: Column) -> Column:
    return matches(text, RATE_WORD)


#: Folds append to arrays of at most so many items; longer ones are folded in pieces of pieces.
PIECE, LEVELS = 64, 2


def let(x: Column, use) -> Column:
    """use(x) with x made once, however often it is used: a name for it inside an expression."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def each(items: str | Column) -> Column:
    """items to be exploded. A bare column would be guarded by a filter on its size, pushed to where it would be made a second time; an expression is not."""
    return F.transform(items, lambda x: x)


def fold(items: Column, start: Column, kind: str, step, carried: str = "int") -> Column:
    """array<kind>: what step() appends in one pass over items.

    step(state, item) returns struct<at: carried, out>: at is carried along (start at first), out the array so far. An append
    copies its array, so pieces are folded by themselves, at passing from one to the next, and joined: a row of a
    million items takes seconds, as what is copied an item is bounded by PIECE.
    """

    def folded(part: Column, at: Column, level: int) -> Column:
        if not level:
            return F.aggregate(part, F.struct(at.alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out")), step)
        span = PIECE**level

        def piece(done: Column, k: Column) -> Column:
            before = F.coalesce(F.try_element_at(done, F.lit(-1))["at"], at)
            return F.array_append(done, let(F.slice(part, k * span + 1, F.lit(span)), lambda x: folded(x, before, level - 1)))

        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(part) / span).cast("int") - 1, F.lit(0)))
        nothing = F.expr(f"cast(array() as array<struct<at: {carried}, out: array<{kind}>>>)")
        return F.aggregate(numbers, nothing, piece, lambda a: F.struct(F.element_at(a, -1)["at"].alias("at"), F.flatten(F.transform(a, lambda x: x["out"])).alias("out")))

    return let(items, lambda x: folded(x, start, LEVELS)["out"])


def occurrences(text: Column, pattern: str | Column) -> Column:
    """All matches as array<struct<start, stop, value>>, in order: every match follows its gap."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def step(a: Column, x: Column) -> Column:
        here = a["at"] + F.length(x["g"])
        stop = here + F.length(x["m"])
        return F.struct(stop.alias("at"), F.array_append(a["out"], F.struct(here.alias("start"), stop.alias("stop"), x["m"].alias("value"))).alias("out"))

    def located(x: Column) -> Column:
        text, found = x["t"], x["m"]
        # only a text with a match is searched a second time
        gaps = F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.expr("cast(array() as array<string>)"))
        pairs = F.filter(F.arrays_zip(found.alias("m"), gaps.alias("g")), lambda x: x["m"].isNotNull())
        return fold(pairs, F.lit(0), "struct<start: int, stop: int, value: string>", step)

    return let(let(text, lambda t: F.struct(t.alias("t"), F.regexp_extract_all(t, pattern, F.lit(0)).alias("m"))), located)


def ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))


def corpus_tokens(text: Column) -> Column:
    """Lower-cased words of the corpus pipeline: no URLs or tags, at least three letters, trimmed of _ and /."""
    rest = F.regexp_replace(F.regexp_replace(F.lower(text), r"""https?://[^\s<>"'`)\]}]+""", " "), r"<[a-z/!][^<>]*>", " ")
    # whole runs, which hold three letters after trimming as before; all their characters are of ASCII
    raw = matches(rest, r"[a-z0-9_/-]{3,}+")
    lettered = F.filter(raw, lambda w: F.length(F.translate(w, "0123456789_/-", "")) >= 3)
    return F.transform(lettered, lambda w: F.rtrim(F.btrim(w, F.lit("_/")), F.lit("-")))


def one_line(text: Column, n: int = 100) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return let(flat, lambda x: F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n - 1)), F.lit("…"))).otherwise(x))


def first_words(text: Column, n: int) -> Column:
    return F.regexp_extract(text, rf"^(?:\s*\S+){{0,{n}}}", 0)
