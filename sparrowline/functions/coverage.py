"""Do the selectors of a site find what they are for, in its list page and one of its detail pages?"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowline.functions.html import json_value, parse, select
from sparrowline.functions.pages import item_link
from sparrowline.functions.selectors import refusal

# Fields that a site may not have, of its list and of its details.
OPTIONAL_LIST = {"company_name", "link", "link_template", "date"}
OPTIONAL_DETAIL = {"qualifications", "recruitment_end_at", "department", "company_name"} | {
    "recruitment_start_at", "job_category", "employment_type", "experience_type", "region",
    "headcount", "responsibilities", "preferred_qualifications", "hiring_process", "recruitment_notice",
}
OK, FAILED, SKIPPED = "ok", "failed", "skipped"
CHECKS = "array<struct<name:string,selector:string,matches:int,status:string,message:string>>"


def _check(name: str, selector: str, matches: int, message: str = "", status: str = "") -> dict:
    return {"name": name, "selector": selector, "matches": matches, "status": status or (OK if matches else FAILED), "message": "" if matches and not status else message}


def list_checks(chosen: dict[str, str], text: str) -> list[dict]:
    """A check for each field of a list: how many items have it; a link counts where it can be followed."""
    item, template = chosen.get("item", ""), chosen.get("link_template", "")
    asked = [n for n in ("title", "link", "date", "company_name") if n in chosen or n not in OPTIONAL_LIST or (n == "link" and template)]
    if why := refusal(item):
        return [_check("list.item", item, 0, why), *(_check(f"list.{n}", chosen.get(n, ""), 0, "list.item is refused") for n in asked)]
    items = select(parse(text), item)
    out = [_check("list.item", item, len(items), "no element")]
    for name in asked:
        selector = chosen.get(name, "")
        if not selector and not (name == "link" and template) and name in OPTIONAL_LIST:
            out.append(_check(f"list.{name}", "", 0, "the list has none", SKIPPED))
        elif why := refusal(selector) if selector or name != "link" else None:
            out.append(_check(f"list.{name}", selector, 0, why))
        elif name == "link":
            links = [item_link(node, selector, template) for node in items]
            reasons = [why for _, why in links if why]
            out.append(_check("list.link", selector or template, len(links) - len(reasons), ": ".join(["no item with a link to follow", *reasons[:1]])))
        else:
            out.append(_check(f"list.{name}", selector, sum(bool(select(node, selector)) for node in items), f"in none of {len(items)} items"))
    return out


def detail_checks(chosen: dict[str, str], text: str) -> list[dict]:
    """A check for each field of a detail page: how many elements it finds."""
    root, out = parse(text), []
    for name, selector in chosen.items():
        if not selector and name in OPTIONAL_DETAIL:
            out.append(_check(f"detail.{name}", "", 0, "the page has none", SKIPPED))
        elif why := refusal(selector):
            out.append(_check(f"detail.{name}", selector, 0, why))
        else:
            out.append(_check(f"detail.{name}", selector, len(select(root, selector)), "no element"))
    return out


def _checked(selectors: pd.Series, list_page: pd.Series, detail_page: pd.Series) -> pd.Series:
    def one(said, of_list, of_detail):
        try:
            chosen = json_value(said)
            parts = [{k: v or "" for k, v in (chosen.get(part) or {}).items()} for part in ("list", "detail")]
        except (ValueError, AttributeError) as e:
            return [_check("selectors", str(said)[:200], 0, f"unreadable: {e}")]
        return list_checks(parts[0], of_list or "") + detail_checks(parts[1], of_detail or "")

    return pd.Series([one(*row) for row in zip(selectors, list_page, detail_page)])


def checks(selectors: Column, list_page: Column, detail_page: Column) -> Column:
    """name, selector, matches, status (ok, failed, skipped) and message of each field, for selectors given as JSON `{list, detail}`.

    A selector that is not understood fails with its reason; one that is empty is skipped where the site may lack the field. Null
    pages are empty; selectors that are no JSON give one failed row.
    """
    return F.pandas_udf(_checked, CHECKS)(selectors, list_page, detail_page)


def verdict(found: Column) -> Column:
    """failed and skipped names, whether all is well, whether the list is missing (each of its checked fields failed), and whether
    items are found but nothing in them (title, link and date failed, as far as they are checked)."""

    def named(*statuses: str) -> Column:
        return F.array_join(F.transform(F.filter(found, lambda f: f["status"].isin(*statuses)), lambda f: f["name"]), ",")

    def all_failed(chosen) -> Column:
        some = F.filter(found, lambda f: chosen(f["name"]) & (f["status"] != SKIPPED))
        return (F.size(some) > 0) & F.forall(some, lambda f: f["status"] == FAILED)

    has_items = F.exists(found, lambda f: (f["name"] == "list.item") & (f["status"] == OK))
    inside = all_failed(lambda n: n.isin("list.title", "list.link", "list.date"))
    return F.struct(
        named(FAILED).alias("failed"),
        named(SKIPPED).alias("skipped"),
        (named(FAILED) == "").alias("ok"),
        all_failed(lambda n: F.startswith(n, F.lit("list."))).alias("list_missing"),
        (has_items & inside).alias("list_fields_missing"),
    )
