"""Predicates over postings: filters compiled from criteria, readiness, reasons, gate.

All take columns and give columns, so a list, its count and its groups share one predicate. What
is "now" or "today" is always an argument.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


def blank(c: Column) -> Column:
    """Null or nothing but spaces."""
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def contains_any_case(columns: Iterable[Column], q: str) -> Column:
    """Any of the columns contains the text, whatever its case; % and _ stand for themselves."""
    literal = q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return any_of(F.coalesce(c, F.lit("")).ilike(f"%{literal}%") for c in columns)


def in_list(c: Column, joined: str) -> Column:
    """The value is among comma-joined ones."""
    return c.isin([v for v in dict.fromkeys(x.strip() for x in joined.split(",")) if v])


def day_of(c: Column) -> Column:
    """The date that a text begins with, or null."""
    return F.try_to_date(F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def deadline_state(day: Column, today: str) -> Column:
    """open, closed or, where there is no readable date, none."""
    now = F.lit(today).cast("date")
    return F.when(day.isNull(), "none").when(day >= now, "open").otherwise("closed")


def not_past(moment: Column, now: str) -> Column:
    """No deadline, or one that is not over on the local clock."""
    return moment.isNull() | (moment >= F.lit(now).cast("timestamp_ntz"))


def missing_names(required: Mapping[str, Column]) -> Column:
    """Names of the required fields that are blank, in the given order."""
    return F.array_compact(F.array(*[F.when(blank(c), F.lit(name)) for name, c in required.items()]))


def not_in_pairs(a: Column, b: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """(a, b) NOT IN (pairs) with SQL's three values: unknown where a null could still match."""
    return all_of(~((a == x) & (b == y)) for x, y in pairs)


def years_cap(years: Column, most: int) -> Column:
    """Blank passes; otherwise a whole number up to the cap."""
    return F.when(blank(years), F.lit(True)).otherwise(F.coalesce(years.try_cast("int") <= most, F.lit(False)))


def allowed(c: Column, wanted: Iterable[str], every: Iterable[str]) -> Column:
    """The value is wanted; wanting all there are turns the filter off."""
    wanted, every = set(wanted), set(every)
    return F.lit(True) if wanted >= every else c.isin(sorted(wanted))


def count_true(conditions: Iterable[Column]) -> Column:
    """How many hold; unknown counts as no."""
    return functools.reduce(operator.add, (F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0))


def with_reasons(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """A boolean column for each reason; unknown stays unknown."""
    return df.withColumns(dict(reasons))


@dataclass(frozen=True)
class PostingFilter:
    """Optional criteria of the review list. Values that are not known are ignored, not refused."""

    q: str = ""
    sources: str = ""
    lang: str = ""
    deadline: str = ""
    reason: str = ""
    least_chars: int | None = None
    quality: int | None = None

    LANGS = ("de", "en", "es", "fr")
    DEADLINES = ("open", "closed", "none")

    @classmethod
    def read(cls, given: Mapping[str, str]) -> PostingFilter:
        def number(name: str) -> int | None:
            text = given.get(name, "").strip()
            return int(text) if text.isdigit() else None

        return cls(
            q=given.get("q", "").strip(),
            sources=given.get("sources", ""),
            lang=given.get("lang", "") if given.get("lang") in cls.LANGS else "",
            deadline=given.get("deadline", "") if given.get("deadline") in cls.DEADLINES else "",
            reason=given.get("reason", ""),
            least_chars=number("least_chars"),
            quality=number("quality"),
        )

    def column(self, columns: Mapping[str, Column], reasons: Mapping[str, Column], today: str) -> Column:
        """The criteria that are set, joined by AND; `columns` names text, source, lang, chars, quality, deadline."""
        out = []
        if self.q:
            out.append(contains_any_case([columns["text"]], self.q))
        if self.sources.strip(", "):
            out.append(in_list(columns["source"], self.sources))
        if self.lang:
            out.append(columns["lang"] == self.lang)
        if self.deadline:
            out.append(deadline_state(columns["deadline"], today) == self.deadline)
        if self.reason in reasons:
            out.append(reasons[self.reason])
        if self.least_chars is not None:
            out.append(columns["chars"] >= self.least_chars)
        if self.quality is not None:
            out.append(columns["quality"] == self.quality)
        return all_of(out)
