"""Dates and times in free text. The date of collection is always given.

Free texts are read in Arrow batches by Python's patterns, whose white space and digits are those
of Unicode: one pass a text gives its day, time of day and days left at once. Fixed formats and
everything counted from a known day are column expressions.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparrowline.functions.text import stripped

OUT = "yyyy-MM-dd HH:mm:ss"

# Fixed value: months in English, by their first letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# Fixed value: a date with an English month.
ENGLISH = re.compile(
    r"(?<![A-Za-z])(?P<month>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(?P<day>\d{1,2})(?:st|nd|rd|th)?"
    r"\s*,?\s*(?P<year>(?:19|20)\d{2})",
    re.IGNORECASE,
)
# Fixed value: a date with its year.
WITH_YEAR = re.compile(r"(?P<year>(?:19|20)\d{2})\s*[.\-/년]\s*(?P<month>\d{1,2})\s*[.\-/월]\s*(?P<day>\d{1,2})")
# Fixed value: a date with a year of two digits.
SHORT_YEAR = re.compile(r"(?<![\d.])(?P<year>\d{2})\s*[.\-/]\s*(?P<month>\d{1,2})\s*[.\-/]\s*(?P<day>\d{1,2})(?!\d)")
# Fixed value: a date without year.
WITHOUT_YEAR = re.compile(r"(?<![\d.])(?P<month>\d{1,2})\s*(?:[./]|월)\s*(?P<day>\d{1,2})(?![\d])")
# Fixed value: between the parts of a period.
TILDES = re.compile(r"[~〜]")
# Fixed value: days left.
DAYS_LEFT = re.compile(r"(?<![A-Za-z])D\s*-\s*(?:(?P<days>\d{1,3})(?!\d)|day)", re.IGNORECASE)
# Fixed value: words for days left.
CLOSING = re.compile(r"(?P<word>오늘|금일|내일)\s*마감")
# Fixed value: days left of either kind, with brackets around them.
COUNTED = re.compile(r"\(?\s*(?:(?<![A-Za-z])D\s*-\s*(?:\d{1,3}(?!\d)|day)|(?:오늘|금일|내일)\s*마감)\s*\)?", re.IGNORECASE)
# Fixed value: a time of day.
CLOCK = re.compile(
    r"(?P<half>오전|오후|AM|PM)?\s*(?P<hour>\d{1,2})\s*(?::\s*(?P<minute>\d{2})|시(?:\s*(?P<minutes>\d{1,2})\s*분)?)",
    re.IGNORECASE,
)
# Words for the afternoon and for tomorrow; years from here on mean no deadline.
AFTERNOON, TOMORROW = ("오후", "PM"), "내일"
NO_DEADLINE_YEAR = 2100
#: A date without year that lies further back than this is one of next year.
BACK_DAYS = 183
#: The order in which dates are tried.
DATES = (ENGLISH, WITH_YEAR, SHORT_YEAR, WITHOUT_YEAR)


class Reading(NamedTuple):
    """What a text says: its first date, the time of day after it, and the day that its days left mean."""

    day: dt.date | None
    clock: dt.time | None
    counted: dt.date | None


def _days(text: str, collected: dt.date) -> Iterator[tuple[dt.date, int]]:
    """Each way of writing a date that the text has: the day, if it is one, and where it ends."""
    for found in filter(None, (p.search(text) for p in DATES)):
        said = found.groupdict()
        month = said["month"] if said["month"].isdecimal() else MONTHS.index(said["month"].lower()) + 1
        year = int(said.get("year") or collected.year)
        try:
            day = dt.date(year + 2000 if year < 100 else year, int(month), int(said["day"]))
            if "year" not in said and (collected - day).days > BACK_DAYS:
                day = day.replace(year=year + 1)
        except ValueError:
            continue
        yield day, found.end()


@functools.lru_cache(1 << 16)
def reading(text: str, collected: dt.date) -> Reading:
    day, end = next(_days(text, collected), (None, 0))
    clock = counted = None
    if day and (at := CLOCK.search(text, end)):
        hour, minute = int(at["hour"]), int(at["minute"] or at["minutes"] or 0)
        hour += 12 if (at["half"] or "").upper() in AFTERNOON and hour < 12 else 0
        clock = dt.time(hour, minute) if hour < 24 and minute < 60 else None
    number, word = DAYS_LEFT.search(text), CLOSING.search(text)
    if number or word:
        ahead = int(number["days"] or 0) if number else int(word["word"] == TOMORROW)
        counted = collected + dt.timedelta(days=ahead)
    return Reading(day, clock, counted)


def moment_of(text: str, collected: dt.date, end: bool) -> str | None:
    """Date and time that a text holds: see `loose_moment`."""
    found = reading(text, collected)
    if end and (parts := TILDES.split(text, maxsplit=1))[1:]:
        later = reading(parts[1], collected)
        found = later if later.day else found
    whole = dt.time(23, 59, 59) if end else dt.time()
    if found.day:
        return f"{found.day} {found.clock or whole}"
    return f"{found.counted} {whole}" if end and found.counted else None


def settled_text(text: str, collected: dt.date) -> str:
    """The text without days left, or the day that they mean: see `without_days_left`."""
    found = reading(text, collected)
    if not found.counted:
        return text
    return COUNTED.sub(" ", text).strip() if found.day else str(found.counted)


def _texts(texts: pd.Series, days: pd.Series, read) -> pd.Series:
    return pd.Series([None if t is None or pd.isna(d) else read(t, d) for t, d in zip(texts, days)], dtype=object)


@F.pandas_udf(StringType())
def _start(texts: pd.Series, days: pd.Series) -> pd.Series:
    return _texts(texts, days, lambda t, d: moment_of(t, d, False))


@F.pandas_udf(StringType())
def _end(texts: pd.Series, days: pd.Series) -> pd.Series:
    return _texts(texts, days, lambda t, d: moment_of(t, d, True))


@F.pandas_udf(StringType())
def _settled(texts: pd.Series, days: pd.Series) -> pd.Series:
    return _texts(texts, days, settled_text)


def loose_moment(text: Column, collected: Column, end: bool = False) -> Column:
    """Date and time that a text holds, as text; null where it holds none.

    For an end, a period's later part counts if it has a date, days left count from collection,
    and a day without time ends at 23:59:59.
    """
    return (_end if end else _start)(text, collected)


@F.pandas_udf(StringType())
def loose_day(texts: pd.Series, days: pd.Series) -> pd.Series:
    """The day of an end that a text holds, as text; null where it holds none."""
    return _texts(texts, days, lambda t, d: (moment_of(t, d, True) or "")[:10] or None)


def register(spark: SparkSession) -> None:
    """`loose_day(text, collected)` as a function of SQL."""
    spark.udf.register("loose_day", loose_day)


def without_days_left(text: Column, collected: Column) -> Column:
    """Days left removed beside a date, or replaced by the date they mean."""
    return _settled(text, collected)


def plain_tilde(text: Column) -> Column:
    """All tilde-like signs as one."""
    return F.translate(text, "〜～∼", "~~~")


def period_split(start: Column, end: Column) -> tuple[Column, Column]:
    """`a ~ b` in the end field gives the start if there is none; `a ~` is a start and no end."""
    parts = F.split(end, TILDES.pattern, 2)
    head, tail = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    is_period = (F.size(parts) == 2) & (F.trim(head) != "")
    has_start = F.trim(F.coalesce(start, F.lit(""))) != ""
    new_start = F.when(is_period & ~has_start, head).otherwise(start)
    new_end = F.when(is_period & (F.trim(tail) == ""), F.lit("")).otherwise(end)
    return new_start, new_end


#: strptime directives as Spark's pattern letters; one letter takes one digit or two.
LETTERS = {"Y": "yyyy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s", "y": "yy", "b": "MMM", "B": "MMMM", "p": "a"}


def spark_format(strptime_format: str, padded: bool = False) -> str:
    """A strptime format as Spark's, `padded` for output; ValueError for directives without a counterpart."""
    out, i = [], 0
    while i < len(strptime_format):
        c = strptime_format[i]
        if c == "%":
            i += 1
            d = strptime_format[i : i + 1]
            if d != "%" and d not in LETTERS:
                raise ValueError(f"%{d} is not supported")
            letters = LETTERS.get(d, d)
            out.append(letters * 2 if padded and d in "mdHIMS" else letters)
        elif c.isalpha():
            out.append(f"'{c}'")
        else:
            out.append("''" if c == "'" else f"'{c}'" if c in "[]{}#" else c)
        i += 1
    return "".join(out)


def has_time(strptime_format: str) -> bool:
    return re.search("%[HIMS]", strptime_format.replace("%%", "")) is not None


def parse_formats(text: Column, formats: Sequence[str], boundary: str | None = None) -> Column:
    """The first format that fits, as a timestamp without zone; a day alone gets the boundary time."""
    tries = []
    for f in formats:
        moment = F.try_to_timestamp(stripped(text), F.lit(spark_format(f))).cast("timestamp_ntz")
        if boundary and not has_time(f):
            moment = F.concat_ws(" ", F.date_format(moment, "yyyy-MM-dd"), F.lit(boundary)).try_cast("timestamp_ntz")
        tries.append(moment)
    return F.coalesce(*tries)


def no_deadline(text: Column) -> Column:
    """A year so far off that it means none."""
    year = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(\d{4})", 1).try_cast("int")
    return F.coalesce(year >= NO_DEADLINE_YEAR, F.lit(False))


def days_label(day: Column, today: Column) -> Column:
    """D-n, D-DAY or closed."""
    left = F.datediff(day, today)
    return F.when(left > 0, F.concat(F.lit("D-"), left)).when(left == 0, "D-DAY").when(left < 0, "closed")


def utc_text(moment: Column) -> Column:
    """ISO 8601 with Z of a UTC timestamp without zone."""
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def local_midnight_utc(day: Column, tz: str) -> Column:
    """When a local day begins, in UTC."""
    return F.to_utc_timestamp(day.cast("timestamp"), tz).cast("timestamp_ntz")


def week_number(day: Column, first: Column) -> Column:
    """Weeks from 1, counted from the first day on."""
    return F.greatest(F.floor(F.datediff(day, first) / F.lit(7)) + 1, F.lit(1)).cast("int")


def period_bounds(name: str, today: Column) -> tuple[Column, Column]:
    """First day and the day after the last of today, 7d, month or last_month."""
    month = F.trunc(today, "month")
    after = F.date_add(today, 1)
    return {
        "today": (today, after),
        "7d": (F.date_sub(today, 6), after),
        "month": (month, after),
        "last_month": (F.add_months(month, -1), month),
    }[name]
