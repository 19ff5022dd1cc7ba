"""Answers of a model, kept only where the source or a list of choices bears them out.

Each check gives a struct: the value that stays (empty where none does), why one was dropped (null
where none was), and the quote that bears it out (null where none was found). All are column
expressions; a posting's fields are checked independently but for those that depend on each other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowline.functions import text as T

NOT_IN_SOURCE, NOT_IN_LIST, OUTSIDE = "not in source", "not in list", "outside"
NO_EVIDENCE, NOT_A_NUMBER, NOT_AN_EMAIL = "no evidence", "not a number", "not an email"
# Fixed value: what counts as an address.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"


def _given(c: Column) -> Column:
    return T.stripped(F.coalesce(c, F.lit("")))


def checked(value: Column, rules: Sequence[tuple[Column, str]], evidence: Column | None = None) -> Column:
    """The value unless one of the rules (fails, reason) holds, the first of them being told; an empty value breaks none."""
    reason = F.lit(None).cast("string")
    for fails, why in reversed(rules):
        reason = F.when(fails, F.lit(why)).otherwise(reason)
    reason = F.when(value != "", reason)
    quote = F.lit(None).cast("string") if evidence is None else F.when((value != "") & reason.isNull(), evidence)
    return F.struct(F.when(reason.isNull(), value).otherwise("").alias("value"), reason.alias("reason"), quote.alias("evidence"))


def in_source(value: Column, source: Column) -> Column:
    """Every line of the value is in the source, loosely compared."""
    return F.size(T.missing_lines(value, source)) == 0


def evidence_of(quote: Column, source: Column) -> Column:
    """The quote if it says something and the source says it; else null."""
    said = _given(quote)
    return F.when((said != "") & in_source(said, source), said)


def extracted(value: Column, source: Column) -> Column:
    """A text that was copied: all its lines must be in the source; said twice, it counts once."""
    folded = T.fold_repeat(_given(value))
    return checked(folded, [(~in_source(folded, source), NOT_IN_SOURCE)])


def judged(value: Column, quote: Column, source: Column, choices: Sequence[str]) -> Column:
    """A choice from a list; it stays without a quote too."""
    chosen = _given(value)
    return checked(chosen, [(~chosen.isin(*choices), NOT_IN_LIST)], evidence_of(quote, source))


def counted(value: Column, quote: Column, source: Column) -> Column:
    """A number of one or two digits that a quote from the source bears out; leading zeros go."""
    given, said = _given(value), evidence_of(quote, source)
    is_number = F.regexp_like(given, F.lit(r"^\d{1,2}$"))
    number = F.when(is_number, given.try_cast("int").cast("string")).otherwise(given)
    return checked(number, [(~is_number, NOT_A_NUMBER), (said.isNull(), NO_EVIDENCE)], said)


def addressed(value: Column, source: Column) -> Column:
    """The address in a text, which the source must hold whatever its case."""
    given = _given(value)
    address = F.regexp_extract(given, f"({EMAIL})", 1)
    missing = ~F.contains(F.lower(F.coalesce(source, F.lit(""))), F.lower(address))
    found = checked(given, [(address == "", NOT_AN_EMAIL), (missing, NOT_IN_SOURCE)])
    return found.withField("value", F.when(found["value"] != "", address).otherwise(""))


def placed(region: Column, inner: Column, quote: Column, source: Column, tree: Mapping[str, Sequence[str]]) -> tuple[Column, Column]:
    """A region and a smaller one, which must lie inside it; the larger one stays without the smaller."""
    outer = judged(region, quote, source, list(tree))
    given = _given(inner)
    parents = F.create_map(*[F.lit(x) for parent, names in tree.items() for n in names for x in (n, parent)])
    parent = F.try_element_at(parents, given)
    return outer, checked(given, [(parent.isNull(), NOT_IN_LIST), (parent != outer["value"], OUTSIDE)])


def field_and_role(field: Column, role: Column, quotes: tuple[Column, Column], source: Column, tree: Mapping[str, Sequence[str]], other: str) -> tuple[Column, Column]:
    """A field and one of its roles. A role of another field is dropped; what was dropped becomes `other`, or
    the field's own other role, the reason being kept."""
    major = judged(field, quotes[0], source, list(tree))
    minor = judged(role, quotes[1], source, sorted({r for roles in tree.values() for r in roles}))
    own = F.coalesce(F.try_element_at(F.create_map(*[x for f, roles in tree.items() for x in (F.lit(f), F.array(*map(F.lit, roles)))]), major["value"]), F.array())
    strays = (minor["value"] != "") & (major["value"] != "") & ~F.array_contains(own, minor["value"])
    reason = F.coalesce(minor["reason"], F.when(strays, F.lit(NOT_IN_LIST)))
    stays = (major["value"] != "") & reason.isNull()
    own_other = F.coalesce(F.get(F.filter(own, lambda r: r.startswith(other)), F.lit(0)), F.lit(other))
    new_role = F.when(stays, minor["value"]).when(reason.isNotNull(), F.when(major["value"] != "", own_other).otherwise(other)).otherwise("")
    minor = F.struct(new_role.alias("value"), reason.alias("reason"), F.when(stays, minor["evidence"]).alias("evidence"))
    return major.withField("value", F.when(major["reason"].isNotNull(), F.lit(other)).otherwise(major["value"])), minor


def dropped(checks: Mapping[str, Column]) -> Column:
    """name: reason of the fields that were dropped, as an array of texts in the given order."""
    return F.array_compact(F.array(*[F.concat(F.lit(f"{name}: "), c["reason"]) for name, c in checks.items()]))
