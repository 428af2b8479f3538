"""Literal needles of a pattern: a text without any of them cannot match.

A substring search costs far less than a regular expression, so counting a
rule's matches in running text starts with it. Only ASCII letters are folded;
parts whose text is not fixed add nothing.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from itertools import product
from operator import or_
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST, MOST_WORDS = 64, 1024


def _worth(needles: frozenset[str] | None) -> tuple[int, int]:
    return (min(map(len, needles)), -len(needles)) if needles else (0, 0)


def _exact(parts, most: int = MOST) -> frozenset[str] | None:
    """All texts that parts can match, where these are few (most) and fixed."""
    texts = [""]
    for op, arg in parts:
        if op is sre.LITERAL and arg < 128:
            options = [chr(arg).lower()]
        elif op is sre.IN and most > MOST and all(kind is sre.LITERAL and x < 128 for kind, x in arg):
            options = {chr(x).lower() for _, x in arg}
        elif op is sre.SUBPATTERN:
            options = _exact(arg[3], most)
        elif op is sre.BRANCH:
            some = [_exact(x, most) for x in arg[1]]
            options = None if None in some else frozenset().union(*some)
        elif op is sre.MAX_REPEAT and arg[1] == 1:
            once = _exact(arg[2], most)
            options = None if once is None else once | {""} if arg[0] == 0 else once
        elif op is sre.AT and arg in (sre.AT_BOUNDARY, sre.AT_BEGINNING):
            options = [""]
        else:
            options = None
        if options is None or len(texts) * len(options) > most:
            return None
        texts = [a + b for a, b in product(texts, options)]
    return frozenset(texts)


def _needles(parts) -> frozenset[str] | None:
    """The best set of literals of which every match holds one, or None."""
    parts, found = list(parts), []
    for i in range(len(parts)):
        # the longest stretch from here on with few fixed texts
        for j in range(len(parts), i, -1):
            if texts := _exact(parts[i:j]):
                found.append(texts)
                break
        op, arg = parts[i]
        if op is sre.SUBPATTERN:
            found.append(_needles(arg[3]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
            found.append(_needles(arg[2]))
        elif op is sre.BRANCH:
            some = [_needles(x) for x in arg[1]]
            found.append(None if None in some else frozenset().union(*some))
    best = max((f for f in found if f and "" not in f and len(f) <= MOST), key=_worth, default=None)
    return best


#: Characters of a word, as the translated word boundary has them.
WORD_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
REPEATS = (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT)


def _apart(parts, beyond: bool, step: int) -> bool:
    """Whether the place beside parts, on the side at which the walk by step begins, is the edge of a word: a boundary is asked for there, or no character of words is taken. beyond: the same for what lies past parts."""
    for op, arg in list(parts)[::step]:
        if op in (sre.ASSERT, sre.ASSERT_NOT):
            continue
        if op is sre.AT:
            return arg in (sre.AT_BOUNDARY, sre.AT_BEGINNING, sre.AT_END)
        if op is sre.LITERAL:
            return chr(arg) not in WORD_CHARACTERS
        if op is sre.IN:
            return all(x is sre.CATEGORY_SPACE if kind is sre.CATEGORY else kind is sre.LITERAL and chr(x) not in WORD_CHARACTERS for kind, x in arg)
        if op is sre.SUBPATTERN:
            # parts that may be empty give no answer
            return _apart(arg[3], False, step)
        if op is sre.BRANCH:
            return all(_apart(x, False, step) for x in arg[1])
        if op in REPEATS:
            if not _apart(arg[2], False, step):
                return False
            if arg[0] == 0:
                continue
            return True
        return False
    return beyond


def _whole(parts, left: bool, right: bool) -> frozenset[str] | None:
    """The best set of whole words of which every match of parts holds one, or None; left, right: whether words end at the edges of parts."""
    parts, found = list(parts), []
    before = [left if i == 0 else _apart(parts[:i], left, -1) for i in range(len(parts) + 1)]
    behind = [_apart(parts[i:], right, 1) for i in range(len(parts) + 1)]
    for i in range(len(parts)):
        for j in range(len(parts), i, -1):
            if not (texts := _exact(parts[i:j], MOST_WORDS)):
                continue
            from_edge = before[i] or parts[i] == (sre.AT, sre.AT_BOUNDARY)
            to_edge = behind[j] or parts[j - 1] == (sre.AT, sre.AT_BOUNDARY)
            words = set()
            for t in texts:
                own = [m[0] for m in re.finditer("[a-z0-9_]+", t) if (m.start() > 0 or from_edge) and (m.end() < len(t) or to_edge)]
                words.add(max(own, key=len, default=""))
            found.append(frozenset(words))
        op, arg = parts[i]
        if op is sre.SUBPATTERN:
            found.append(_whole(arg[3], before[i], behind[i + 1]))
        elif op in REPEATS and arg[0] > 0:
            once = arg[1] == 1
            found.append(_whole(arg[2], before[i] and once, behind[i + 1] and once))
        elif op is sre.BRANCH:
            some = [_whole(x, before[i], behind[i + 1]) for x in arg[1]]
            found.append(None if None in some else frozenset().union(*some))
    return max((f for f in found if f and "" not in f and len(f) <= MOST_WORDS), key=_worth, default=None)


@cache
def whole_words_of(pattern: str) -> frozenset[str] | None:
    """Lower-cased words (runs of ASCII letters, digits and _) of which every match of the pattern holds at least one, from edge to edge; None where there are none."""
    try:
        return _whole(sre_parser.parse(pattern), False, False)
    except re.error:
        return None


def needles_of(pattern: str) -> list[str] | None:
    """Lower-cased literals of which every match of the pattern holds at least one; None where there are none of two letters or more."""
    try:
        found = _needles(sre_parser.parse(pattern))
    except re.error:
        return None
    if not found or _worth(found)[0] < 2:
        return None
    return sorted(n for n in found if not any(m != n and m in n for m in found))


#: Code points of the classes of the rule dialect.
DIGIT, BLANKS = [(48, 57)], [(9, 13), (32, 32), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
WORD = [*DIGIT, (65, 90), (95, 95), (97, 122)]
CLASS = {sre.CATEGORY_DIGIT: DIGIT, sre.CATEGORY_WORD: WORD, sre.CATEGORY_SPACE: BLANKS}


def _begins(parts) -> tuple[list[tuple[int, int]], bool, bool]:
    """(ranges that hold the first character of what parts match, whether a word boundary stands before each, whether parts may match nothing); ValueError if not known."""
    found, bounded, before = [], True, False
    for op, arg in parts:
        if op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
            before |= op is sre.AT and arg is sre.AT_BOUNDARY
            continue
        some, alone, empty = [], False, False
        if op is sre.LITERAL:
            some = [(arg, arg)]
        elif op is sre.IN and arg[0][0] is not sre.NEGATE:
            for kind, x in arg:
                if kind is sre.CATEGORY and x not in CLASS:
                    raise ValueError(f"no first characters of {x}")
                some += CLASS[x] if kind is sre.CATEGORY else [(x, x) if kind is sre.LITERAL else x]
        elif op is sre.SUBPATTERN and not arg[1] and not arg[2]:
            some, alone, empty = _begins(arg[3])
        elif op is sre.BRANCH:
            each = [_begins(x) for x in arg[1]]
            some, alone, empty = [c for e in each for c in e[0]], all(e[1] for e in each), any(e[2] for e in each)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            some, alone, empty = _begins(arg[2])
            empty |= arg[0] == 0
        else:
            raise ValueError(f"no first characters of {op}")
        found += some
        bounded &= before or alone
        if not empty:
            return found, bounded, False
    return found, bounded, True


def begins_of(pattern: str) -> tuple[list[tuple[int, int]], bool] | None:
    """(ranges of code points that hold every match's first character, whether every match begins where a word does); None if not known."""
    try:
        found, bounded, empty = _begins(sre_parser.parse(pattern))
    except (re.error, ValueError):
        return None
    within = lambda a, b: any(x <= a and b <= y for x, y in WORD)
    return None if empty or not found else (sorted(set(found)), bounded and all(within(a, b) for a, b in found))


def may_match(lowered: Column, pattern: str) -> Column | None:
    """Whether the lower-cased text holds a needle of the pattern."""
    found = needles_of(pattern)
    if found is None:
        return None
    if len(found) <= 2:
        return reduce(or_, (F.contains(lowered, F.lit(n)) for n in found))
    # a constant array keeps the generated code of many rules small
    return F.exists(F.array(*map(F.lit, found)), lambda n: F.contains(lowered, n))
