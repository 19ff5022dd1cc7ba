"""Python's patterns on columns.

A pattern is parsed by Python's own parser and written again for the JVM's engine, construct by
construct, each sign by its code: nothing in it can mean something else there. Digits, spaces, words, ends
of lines and word edges are spelled out as Python has them. What has no sure counterpart (letters of
any case, patterns that can find nothing, conditional groups, whatever the parser learns next) runs in
an Arrow batch by Python itself, so each pattern that Python accepts gives Python's answer, and one
that it refuses is a `ValueError`.
"""

from __future__ import annotations

import functools
import re
from re import _constants as K
from re import _parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: All of Unicode's white space that Python counts.
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What a class of characters says about itself and, negated, about all others.
CATEGORIES = {
    K.CATEGORY_DIGIT: (r"\p{Nd}", r"\P{Nd}"),
    K.CATEGORY_SPACE: (SPACE, f"[^{SPACE}]"),
    K.CATEGORY_WORD: (r"\p{L}\p{N}_", r"[^\p{L}\p{N}_]"),
}
OPPOSITE = {K.CATEGORY_NOT_DIGIT: K.CATEGORY_DIGIT, K.CATEGORY_NOT_SPACE: K.CATEGORY_SPACE, K.CATEGORY_NOT_WORD: K.CATEGORY_WORD}
WORD = r"[\p{L}\p{N}_]"
EDGES = {
    K.AT_BEGINNING: r"\A",
    K.AT_BEGINNING_STRING: r"\A",
    K.AT_END: r"(?=\x{a}?\z)",
    K.AT_END_STRING: r"\z",
    K.AT_BOUNDARY: f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))",
    K.AT_NON_BOUNDARY: f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))",
}
MULTILINE = {K.AT_BEGINNING: r"(?:\A|(?<=\x{a}))", K.AT_END: r"(?=\x{a}|\z)"}
REPEATS = {K.MAX_REPEAT: "", K.MIN_REPEAT: "?", K.POSSESSIVE_REPEAT: "+"}
UNDERSTOOD = re.UNICODE | re.MULTILINE | re.DOTALL | re.VERBOSE


class NoCounterpart(ValueError):
    """Python has to run this pattern."""


def _one(code: int) -> str:
    if 0xD800 <= code < 0xE000:
        raise NoCounterpart("half of a pair")
    return rf"\x{{{code:x}}}"


def _class(items) -> str:
    """A set of signs: one class, or, where a negated category is in it, a choice of them."""
    inside, apart, negated = "", [], False
    for what, x in items:
        if what is K.NEGATE:
            negated = True
        elif what is K.LITERAL:
            inside += _one(x)
        elif what is K.RANGE:
            inside += f"{_one(x[0])}-{_one(x[1])}"
        elif what is K.CATEGORY and x in CATEGORIES:
            inside += CATEGORIES[x][0]
        elif what is K.CATEGORY and x in OPPOSITE:
            apart.append(CATEGORIES[OPPOSITE[x]][1])
        else:
            raise NoCounterpart(str(what))
    choices = ([f"[{inside}]"] if inside else []) + apart
    if negated and not apart:
        return f"[^{inside}]"
    whole = choices[0] if len(choices) == 1 else f"(?:{'|'.join(choices)})"
    return rf"(?!{whole})(?s:.)" if negated else whole


def _written(parsed, flags: int) -> str:
    out = ""
    for what, x in parsed:
        if what is K.LITERAL:
            out += _one(x)
        elif what is K.NOT_LITERAL:
            out += f"[^{_one(x)}]"
        elif what is K.ANY:
            out += "(?s:.)" if flags & re.DOTALL else r"[^\x{a}]"
        elif what is K.IN:
            out += _class(x)
        elif what is K.BRANCH:
            out += f"(?:{'|'.join(_written(p, flags) for p in x[1])})"
        elif what is K.SUBPATTERN:
            number, on, off, inner = x
            if (on | off) & ~UNDERSTOOD:
                raise NoCounterpart("flags of a group")
            inner = _written(inner, (flags | on) & ~off)
            out += f"({inner})" if number is not None else f"(?:{inner})"
        elif what in REPEATS:
            least, most, inner = x
            inner = _written(inner, flags)
            # One sign needs no group, and the JVM's engine repeats it without a deep stack.
            single = re.fullmatch(r"\\x\{[0-9a-f]+\}|\\[pP]\{Nd\}|\[[^\[\]]*\]|\(\?s:\.\)", inner)
            out += (inner if single else f"(?:{inner})") + ("*" if (least, most) == (0, K.MAXREPEAT) else f"{{{least},{'' if most is K.MAXREPEAT else most}}}") + REPEATS[what]
        elif what is K.ATOMIC_GROUP:
            out += f"(?>{_written(x, flags)})"
        elif what is K.AT and x in EDGES:
            out += (MULTILINE.get(x) if flags & re.MULTILINE else None) or EDGES[x]
        elif what is K.GROUPREF:
            out += rf"(?:\{x})" if x < 10 else _refuse("many groups")
        elif what in (K.ASSERT, K.ASSERT_NOT):
            sign = "=" if what is K.ASSERT else "!"
            out += f"(?{'' if x[0] > 0 else '<'}{sign}{_written(x[1], flags)})"
        else:
            raise NoCounterpart(str(what))
    return out


def _refuse(why: str):
    raise NoCounterpart(why)


def java_pattern(pattern: str) -> str | None:
    """The same pattern for the JVM's engine; null where Python has to run it. A `ValueError` for what is no pattern."""
    try:
        re.compile(pattern)
        parsed = _parser.parse(pattern)
        flags = parsed.state.flags
        if flags & ~UNDERSTOOD:
            return None
        # After nothing Python tries the same place again for something; the JVM goes on.
        return _written(parsed, flags) if parsed.getwidth()[0] else None
    except NoCounterpart:
        return None
    except (re.error, OverflowError, RecursionError) as e:
        raise ValueError(f"pattern {pattern!r}: {e}") from e


def java_replacement(pattern: str, replacement: str) -> str:
    """A replacement's groups and escapes, as the JVM's engine takes them."""
    try:
        parts = _parser.parse_template(replacement, re.compile(pattern))
    except (re.error, IndexError) as e:
        raise ValueError(f"replacement {replacement!r}: {e}") from e
    out = ""
    for part in parts:
        # A number is that of a group; braces would be a name, so a digit after it is escaped.
        if isinstance(part, int):
            out += f"${part}"
        else:
            out += "".join(f"\\{c}" if c in "\\$0123456789" else c for c in part)
    return out


def substituted(c: Column, pattern: str, replacement: str) -> Column:
    """`re.sub(pattern, replacement, text)` of a column; null stays null."""
    java, new = java_pattern(pattern), java_replacement(pattern, replacement)
    if java is not None:
        return F.regexp_replace(c, F.lit(java), F.lit(new))
    return _by_python(pattern, replacement)(c)


@functools.lru_cache(256)
def _by_python(pattern: str, replacement: str):
    def run(texts: pd.Series) -> pd.Series:
        found = re.compile(pattern)
        return texts.map(lambda t: None if t is None else found.sub(replacement, t))

    return F.pandas_udf(run, "string")
