"""Identity, comparison and shaping of texts, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a hash are kept apart by the unit separator.
UNIT = "\x1f"
# What comparisons of texts leave out.
NOISE = r"(?U)[\s·•◦○●□■▪▶▷–—\-*_.,;:!?()\[\]{}<>\"'`~/\\|]+"
QUOTE_NOISE = r"(?U)[\s\"'“”‘’`·•\-–—*■□▶▷>]+"
TITLE_BREAKS = r"(?U)[\s\[\]()<>{}/|·,:\-]+"
UNSTATED = r"^(공고에\s*)?(명시\s*)?(없음|없어요|미기재|명시되지 않음)\.?$"
LEGAL_FORMS = ("주식회사", "유한회사", "(주)", "㈜", "(유)")
LOGIN = r"(?i)login|signin|sign-in|sign_in|auth"
# Fixed value: what stands before text that was read from images.
IMAGE_TEXT_MARK = "[이미지에 적힌 글]"
# What ends a line, and spaces inside it.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
LINE_SPACES = r"[ \t\u00A0\u3000\u200B]+"
# How pages say that a list is empty.
NOTHING_LISTED = (
    r"(?:채용\s*공고|공고|포지션|채용|모집|게시물|게시글|검색\s*결과|조회\s*결과|데이터|직무)\s*(?:이|가|은|는)\s*(?:현재\s*|아직\s*)?없",
    r"(?i)\bno\s+(?:current\s+|open\s+|available\s+)?(?:open\s+)?(?:positions?|openings?|jobs?|vacancies|roles?|results?)\b"
    r"|\bthere\s+are\s+(?:currently\s+)?no\b",
)
# What titles of talent pools hold, without white space and in lower case.
TALENT_POOL = ("인재pool", "인재풀", "talentpool", "인재등록", "인재db", "db등록", "상시등록")


#: White space of Unicode, with the separators of files, groups, records and units.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """The text without white space at its ends, line feeds and tabs among it. `F.trim` takes spaces only: it is right where
    the tables' own `trim` is meant."""
    return F.btrim(c, F.lit(SPACES))


def filled(c: Column) -> Column:
    """The value, null where it is empty after stripping."""
    return F.nullif(stripped(c), F.lit(""))


def squeezed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1C-\x1F]+", " "))


def content_hash(parts: Sequence[Column]) -> Column:
    """SHA-256 of the parts, white space squeezed, null as empty."""
    return F.sha2(F.concat_ws(UNIT, *[F.coalesce(squeezed(p), F.lit("")) for p in parts]), 256)


def canonical_url(url: Column, dropped: str) -> Column:
    """The url without query pieces that match once decoded; untouched if there are none."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    pieces = F.split(query, "&")

    def goes(piece: Column) -> Column:
        plain = F.coalesce(F.try_url_decode(F.replace(piece, F.lit("+"), F.lit("%2B"))), piece)
        return F.regexp_like(plain, F.lit(dropped))

    kept = F.filter(pieces, lambda p: ~goes(p))
    head, tail = F.substring_index(F.substring_index(url, "#", 1), "?", 1), F.regexp_extract(url, r"(?s)(#.*)$", 1)
    rest = F.array_join(kept, "&")
    rebuilt = F.concat(head, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""), tail)
    return F.when((query != "") & (F.size(kept) < F.size(pieces)), rebuilt).otherwise(url)


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def part_url(url: Column, part: Column, split: Column) -> Column:
    """The url of one part of a split posting."""
    return F.when(split, F.concat(url, F.lit("#"), part.cast("string"))).otherwise(url)


def loose(c: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), NOISE, ""))


def missing_lines(value: Column, body: Column, least: int = 2) -> Column:
    """Lines of the value that the body does not hold, loosely compared; too short ones are not looked for."""
    hay = loose(body)
    lines = F.split(F.coalesce(value, F.lit("")), r"\r\n|\r|\n")
    gone = F.filter(lines, lambda line: (F.length(loose(line)) >= least) & ~F.contains(hay, loose(line)))
    return F.transform(gone, stripped)


def fold_repeat(value: Column) -> Column:
    """The first half where the second half has the same lines."""
    lines = F.split(value, "\n")
    half = F.floor(F.size(lines) / F.lit(2)).cast("int")
    first = F.slice(lines, 1, F.greatest(half, F.lit(1)))
    second = F.slice(lines, half + 1, F.greatest(half, F.lit(1)))
    even = (F.size(lines) >= 2) & (F.size(lines) % 2 == 0)
    return F.when(even & (first == second), F.array_join(first, "\n")).otherwise(value)


def numbers_of(ranges: Column) -> Column:
    """Line numbers of packed ranges [[1,3],[7,7]]."""
    return F.flatten(F.transform(ranges, lambda r: F.sequence(r[0], r[1])))


def shows_title(text: Column, title: Column, share: float = 0.6) -> Column:
    """The title is in the text, or enough of its words of two letters or more are."""
    hay = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))
    whole = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", ""))
    words = F.filter(F.split(F.coalesce(title, F.lit("")), TITLE_BREAKS), lambda w: F.length(w) >= 2)
    seen = F.size(F.filter(words, lambda w: F.contains(hay, F.lower(w))))
    enough = (F.size(words) > 0) & (seen >= F.size(words) * F.lit(share))
    return (whole != "") & (F.contains(hay, whole) | enough)


#: From so many letters on a title counts inside a longer one.
TITLE_INSIDE = 6


def same_title(a: Column, b: Column) -> Column:
    """Equal, or one of six letters or more is inside the other and half as long at least."""
    a, b = squeezed(a), squeezed(b)
    inside = (F.length(a) >= TITLE_INSIDE) & F.contains(b, a) & (F.length(a) * 2 >= F.length(b))
    return F.coalesce((a == b) | inside, F.lit(False))


def clip(c: Column, most: int) -> Column:
    return F.substring(squeezed(c), 1, most)


def stated(c: Column, most: int = 300) -> Column:
    """The clipped text, null where it only says that nothing is stated."""
    text = clip(c, most)
    return F.when(~F.regexp_like(text, F.lit(UNSTATED)), F.nullif(text, F.lit("")))


def grounded_names(items: Column, source: Column) -> tuple[Column, Column]:
    """Of (name, quote) structs those whose quote is in the source, and the names of the others."""
    hay = F.regexp_replace(F.coalesce(source, F.lit("")), QUOTE_NOISE, "")

    def found(i: Column) -> Column:
        quote = F.regexp_replace(F.coalesce(i["quote"], F.lit("")), QUOTE_NOISE, "")
        return (squeezed(i["quote"]) != "") & F.contains(hay, quote)

    named = F.filter(items, lambda i: F.coalesce(squeezed(i["name"]), F.lit("")) != "")
    kept = F.filter(named, lambda i: F.coalesce(found(i), F.lit(False)))
    lost = F.filter(named, lambda i: ~F.coalesce(found(i), F.lit(False)))
    return kept, F.transform(lost, lambda i: i["name"])


def allow_list(names: Column, allowed: Sequence[str], most: int, renamed: Mapping[str, str] | None = None) -> tuple[Column, Column]:
    """(kept, dropped): trimmed names, former ones renamed, of a list in their order, each once and `most` at most; the rest."""
    table = F.create_map(*[F.lit(x) for pair in (renamed or {"": ""}).items() for x in pair])
    clean = F.filter(F.transform(names, lambda n: F.coalesce(F.try_element_at(table, stripped(n)), stripped(n))), lambda n: n != "")
    whole = F.array(*[F.lit(a) for a in allowed])
    kept = F.slice(F.array_distinct(F.filter(clean, lambda n: F.array_contains(whole, n))), 1, most)
    return kept, F.filter(clean, lambda n: ~F.array_contains(whole, n))


def main_of(c: Column) -> Column:
    """The first of comma-joined names."""
    return stripped(F.substring_index(c, ",", 1))


def first_count(c: Column) -> Column:
    """The first number of 1 or more in a text, thousands' commas allowed."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d[\d,]*)")), lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("long"))
    return F.get(F.filter(numbers, lambda n: n >= 1), F.lit(0))


def typed(c: Column, kind: Column, choices: Column) -> Column:
    """A custom field's value by its kind (text, long, choice, number, date); what does not fit is empty."""
    text = stripped(F.coalesce(c, F.lit("")))
    number = F.replace(text, F.lit(","), F.lit(""))
    return (
        F.when(kind == "choice", F.when(F.array_contains(choices, text), text))
        .when(kind == "number", F.when(F.regexp_like(number, F.lit(r"^-?\d+(\.\d+)?$")), number))
        .when(kind == "date", F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), text))
        .otherwise(text)
    )


def paragraphs(c: Column, skipped: str = IMAGE_TEXT_MARK) -> Column:
    """A text as HTML: lines of a paragraph broken, blank lines between paragraphs; null where there is none."""
    lines = F.transform(F.split(c, LINE_ENDS), lambda x: F.regexp_replace(F.regexp_replace(x, LINE_SPACES, " "), r"(?U)^\s+|\s+$", ""))
    safe = F.array_join(F.filter(lines, lambda x: x != skipped), "\n")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    blocks = F.filter(F.split(F.regexp_replace(safe, r"^\n+|\n+$", ""), r"\n{2,}"), lambda p: p != "")
    html = F.transform(blocks, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    return F.nullif(F.array_join(html, ""), F.lit(""))


def with_other(field: Column, role: Column, tree: Mapping[str, Sequence[str]], other: str) -> tuple[Column, Column]:
    """A field and its role by the tree of choices. A field that is not in it becomes `other`, and so
    does its role; a role that is not the field's own becomes the field's first one that starts
    with `other`, or `other` where it has none."""
    known = F.coalesce(field.isin(*tree), F.lit(False))
    kept = F.lit(other)
    for name, roles in tree.items():
        own = next((r for r in roles if r.startswith(other)), other)
        kept = F.when(field == name, F.when(role.isin(*roles), role).otherwise(own)).otherwise(kept)
    return F.when(known, field).otherwise(other), kept


def empty_notice(text: Column, around: int = 20) -> Column:
    """Where a page's visible text says that there is nothing listed: the words with some around them, else empty."""

    def said(pattern: str) -> Column:
        at = F.regexp_instr(text, F.lit(pattern))
        start = F.greatest(at - around, F.lit(1))
        end = at + F.length(F.regexp_extract(text, pattern, 0)) + around
        return F.when(at > 0, F.trim(F.substring(text, start, end - start)))

    return F.coalesce(*[said(p) for p in NOTHING_LISTED], F.lit(""))


def as_choice(c: Column, allowed: Iterable[str]) -> Column:
    value = filled(c)
    return F.when(value.isin(list(allowed)), value)


def as_count(c: Column) -> Column:
    """A whole number of 1 or more, else null."""
    number = F.when(F.regexp_like(stripped(c), F.lit(r"^\d{1,9}$")), stripped(c)).try_cast("int")
    return F.when(number >= 1, number)


def as_flag(c: Column) -> Column:
    value = stripped(c)
    return F.when(value == "true", True).when(value == "false", False)


def as_moment(c: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS` with a T between; null for any other shape."""
    value = stripped(c)
    return F.when(F.regexp_like(value, F.lit(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")), F.replace(value, F.lit(" "), F.lit("T")))


def company_key(name: Column) -> Column:
    """A company's name without legal forms and anything but letters and digits."""
    text = F.lower(name)
    for form in LEGAL_FORMS:
        text = F.replace(text, F.lit(form), F.lit(""))
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def has_legal_form(name: Column) -> Column:
    out = F.lit(False)
    for form in LEGAL_FORMS:
        out = out | F.contains(name, F.lit(form))
    return out


def is_talent_pool(title: Column) -> Column:
    tight = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", ""))
    return F.regexp_like(tight, F.lit("|".join(TALENT_POOL)))


def without_order(name: Column) -> Column:
    """A lesson's name without its leading ordinal."""
    rest = F.trim(F.substring(name, F.instr(name, " "), F.length(name)))
    ordinal = F.substring_index(name, " ", 1).endswith("차시") & (F.instr(name, " ") > 0) & (rest != "")
    return F.when(ordinal, rest).otherwise(F.trim(name))


def liveness(url: Column, final_url: Column, status: Column, text: Column, title: Column, closed_words: str) -> Column:
    """(verdict, reason) of a fetched page: open, closed or unknown.

    Gone by status; sent to a login page: unknown; sent from a page to its site's front: closed; no
    text: unknown; title shown and no closing words: open; otherwise unknown.
    """

    def host(u: Column) -> Column:
        return F.regexp_replace(F.lower(F.regexp_extract(u, r"://([^/?#]*)", 1)), r"^www\.", "")

    def place(u: Column) -> Column:
        return F.regexp_extract(u, r"://[^/?#]*([^#]*)", 1)

    moved = (F.regexp_extract(url, r"://([^#]*)", 1) != F.regexp_extract(final_url, r"://([^#]*)", 1)) & final_url.isNotNull()
    front = F.regexp_like(place(final_url), F.lit(r"^/*\??$")) & ~F.regexp_like(place(url), F.lit(r"^/*\??$"))
    out = F.struct(F.lit("unknown").alias("verdict"), F.lit("not clear").alias("reason"))
    for condition, verdict, reason in reversed(
        [
            (status.isin(404, 410), "closed", "gone"),
            (status >= 400, "unknown", "refused"),
            (moved & F.regexp_like(place(final_url), F.lit(LOGIN)), "unknown", "login"),
            (moved & (host(url) == host(final_url)) & front, "closed", "front page"),
            (stripped(F.coalesce(text, F.lit(""))) == "", "unknown", "no text"),
            (shows_title(text, title) & ~F.regexp_like(text, F.lit(closed_words)), "open", "title shown"),
        ]
    ):
        out = F.when(condition, F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"))).otherwise(out)
    return out
