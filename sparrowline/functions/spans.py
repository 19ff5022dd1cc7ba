"""Copied pieces as they stand in their source.

A source is folded once: letters and signs that carry meaning in lower case, with the place each
came from and a barrier between lines. All pieces are folded alike and looked for together by one
automaton, in one pass over the source: what that costs grows with the source and the pieces, not
with their product. What comparisons leave out is what they leave out everywhere (`text.NOISE`), so
`+`, `#`, `%` and their like tell `C++` from `C#` and `10%` from `10`.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Sequence
from os.path import commonprefix
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowline.functions.text import NOISE

#: Signs that are left out, one by one.
_LEFT_OUT = re.compile(NOISE.removeprefix("(?U)"))
#: Between lines of a folded source: never in a folded piece.
BARRIER = "\n"
# Fixed value: marks that may stand before and after a piece; a folded piece of fewer signs is not looked for.
BEFORE, AFTER = "([{<\"'", ")]}>.!?\"'"
PAIRS = {")": "(", "]": "[", "}": "{", ">": "<"}
LEAST = 2
# Fixed value: a line's number before it.
LINE_MARK = re.compile(r"^\s*\[\d+\]\s*", re.MULTILINE)


def folded(text: str) -> tuple[str, list[int]]:
    """What is compared of a text, and where each sign of it came from."""
    signs, places, at = [], [], 0
    for noise in [*_LEFT_OUT.finditer(text), None]:
        kept = text[at : noise.start() if noise else len(text)]
        if kept.isascii():
            signs.append(kept.lower())
            places += range(at, at + len(kept))
        else:  # a letter may become two
            for i, low in enumerate(map(str.lower, kept), at):
                signs.append(low)
                places += [i] * len(low)
        at = noise.end() if noise else at
    return "".join(signs), places


class Source:
    """A source's lines, folded one after the other."""

    def __init__(self, lines: Sequence[str]):
        self.lines = lines
        self.starts: list[int] = []
        self.places: list[list[int]] = []
        parts, size = [], 0
        for line in lines:
            text, places = folded(line)
            self.starts.append(size)
            self.places.append(places)
            parts.append(text + BARRIER)
            size += len(text) + 1
        self.text = "".join(parts)

    def find(self, wanted: Sequence[tuple[int, str]]) -> dict[tuple[int, str], tuple[int, int]]:
        """For each (line, folded piece) the line and the place in it where it stands: its own line, else the first that has it."""
        pieces = {piece for _, piece in wanted if len(piece) >= LEAST}
        if not pieces:
            return {}
        automaton = ahocorasick.Automaton()
        for piece in pieces:
            automaton.add_word(piece, piece)
        automaton.make_automaton()
        asked, first, own = set(wanted), {}, {}
        for end, piece in automaton.iter(self.text):
            start = end - len(piece) + 1
            line = bisect_right(self.starts, start) - 1
            at = line, start - self.starts[line]
            first.setdefault(piece, at)
            if (line, piece) in asked:
                own.setdefault((line, piece), at)
        return {key: at for key in asked if (at := own.get(key) or first.get(key[1]))}

    def cut(self, at: tuple[int, int], size: int, said: str) -> str:
        """The span of a line that a found piece stands for, with the marks around it."""
        line, places = self.lines[at[0]], self.places[at[0]]
        return widened(line, places[at[1]], places[at[1] + size - 1] + 1, said)


def widened(line: str, lo: int, hi: int, said: str) -> str:
    """A span with the marks that stand around it both in the line and in what was said, and with brackets that it opens or closes."""
    head = said[: len(said) - len(said.lstrip(BEFORE))]
    tail = said[len(said.rstrip(AFTER)) :]
    lo -= len(commonprefix([head[::-1], line[max(0, lo - len(head)) : lo][::-1]]))
    hi += len(commonprefix([tail, line[hi : hi + len(tail)]]))
    # How many brackets of each kind the span leaves open, or closes without having opened them.
    counts = Counter(line[lo:hi])
    spare = {mate: counts[mate] - counts[mark] for mark, mate in PAIRS.items()}
    while hi < len(line) and spare.get(mate := PAIRS.get(line[hi]), 0) > 0:
        spare[mate] -= 1
        hi += 1
    while lo and spare.get(line[lo - 1], 0) < 0:
        spare[line[lo - 1]] += 1
        lo -= 1
    return line[lo:hi]


class Piece(NamedTuple):
    text: str | None
    #: exact: as the source has it; line: the line pointed at, whole; lost: nowhere.
    how: str


def resolve(lines: Sequence[str], pieces: Sequence[tuple[int, str]]) -> list[Piece]:
    """Where (line, text) pieces stand in the lines of a source; pieces that say nothing are left out."""
    source = Source(lines)
    said = [(line, LINE_MARK.sub("", text).strip()) for line, text in pieces]
    keyed = [(line, folded(text)[0], text) for line, text in said]
    found = source.find([(line, key) for line, key, _ in keyed])
    out = []
    for line, key, text in keyed:
        if not key:
            continue
        at = found.get((line, key))
        pointed = lines[line] if 0 <= line < len(lines) else ""
        if at:
            out.append(Piece(source.cut(at, len(key), text), "exact"))
        else:
            out.append(Piece(pointed or None, "line" if pointed else "lost"))
    return out


def located(line: str, piece: str) -> str | None:
    """The part of a line that a loosely copied piece stands for; null where the line has none."""
    [found] = resolve([line], [(-1, piece)]) or [Piece(None, "lost")]
    return found.text if found.how == "exact" else None


FOUND = "array<struct<text:string,how:string>>"


def _resolved(sources: pd.Series, lines: pd.Series, texts: pd.Series) -> pd.Series:
    def one(source, numbers, said):
        if numbers is None or said is None:
            return []
        pieces = [(-1 if n is None or n != n else int(n), t or "") for n, t in zip(numbers, said)]
        return [p._asdict() for p in resolve((source or "").split("\n"), pieces)]

    return pd.Series([one(*row) for row in zip(sources, lines, texts)])


def resolved_pieces(source: Column, pieces: Column) -> Column:
    """value, whole_lines, lost: pieces (an array of structs line, text) as the source has them, in their own line, else in the
    first that has them, else their line whole; each text once. A null source has one empty line; a null line points nowhere."""
    numbers, texts = F.transform(pieces, lambda p: p["line"].cast("int")), F.transform(pieces, lambda p: p["text"])
    found = F.pandas_udf(_resolved, FOUND)(source, numbers, texts)
    kept = F.array_distinct(F.array_compact(F.transform(found, lambda f: f["text"])))

    def how(name: str) -> Column:
        return F.size(F.filter(found, lambda f: f["how"] == name))

    return F.struct(F.array_join(kept, "\n").alias("value"), how("line").alias("whole_lines"), how("lost").alias("lost"))


def resolved_span(source: Column, piece: Column) -> Column:
    """The exact piece of a whole source, over all its lines, that a loosely copied piece stands for; null where there is none."""

    def run(sources: pd.Series, pieces: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or p is None else located(s, p) for s, p in zip(sources, pieces)], dtype=object)

    return F.pandas_udf(run, "string")(source, piece)
