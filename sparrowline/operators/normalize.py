"""The normalization of postings: rules first, then layers that each overrule the one before.

raw -> rules -> classification -> fallbacks -> company -> url and title -> overrides -> logo -> settled
The order is part of the result: logos are looked up by the company that overrides leave, and
the settled fields come last. All of it is joins on (raw_job_id, part) and column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparrowline.functions import dates
from sparrowline.functions import text as T
from sparrowline.operators.rules import Rule, normalized

START, END = "recruitment_start_at", "recruitment_end_at"
NO_EXPERIENCE_SAID = "IRRELEVANT"


def expand_parts(raw: DataFrame, parts: DataFrame) -> DataFrame:
    """A row for each part of a posting, one where it has none; `split`: it has several."""
    size = F.count("part").over(W.partitionBy("raw_job_id"))
    rows = raw.join(parts, "raw_job_id", "left").withColumn("split", size > 1)
    return rows.withColumn("part", F.coalesce("part", F.lit(1)))


def overlay(value: Column, classified: Column, other: Column, default: str | None = None) -> Column:
    """A classified posting's value, blank clearing it (or giving the default); else what there was."""
    new = T.filled(other)
    return F.when(classified, F.coalesce(new, F.lit(default)) if default else new).otherwise(value)


def fill_company(value: Column, by_model: Column) -> Column:
    return F.coalesce(T.filled(by_model), value)


def fill_date(value: Column, by_model: Column, model_decides: Column, collected: Column, end: bool) -> Column:
    """The model's date if it decides or there is none; a start that stays open is the day of collection."""
    read = dates.loose_moment(T.filled(by_model), collected, end=end)
    out = F.when((F.coalesce(value, F.lit("")) != "") & ~F.coalesce(model_decides, F.lit(False)), value).otherwise(read)
    return out if end else F.coalesce(out, F.date_format(collected, "yyyy-MM-dd 00:00:00"))


def best_names(companies: DataFrame) -> DataFrame:
    """parent, key, best: of a parent's companies and itself that are the same but for legal forms,
    the one without a legal form, then the first registered."""
    group = companies.select(F.col("parent_name").alias("parent"), "name", "id").filter("parent IS NOT NULL")
    group = group.union(companies.select(F.col("name").alias("parent"), "name", "id")).distinct()
    best = group.groupBy("parent", T.company_key(F.col("name")).alias("key")).agg(
        F.min(F.struct(T.has_legal_form(F.col("name")).alias("formal"), "id", "name")).alias("best")
    )
    return best.filter("key <> ''")


def with_canonical(rows: DataFrame, companies: DataFrame, name: str) -> DataFrame:
    """rows(parent, name) with `canonical`: the best name of its parent's companies, else the name as it is."""
    own = T.stripped(F.col(name))
    found = rows.withColumn("_key", T.company_key(own)).join(best_names(companies).withColumnRenamed("key", "_key"), ["parent", "_key"], "left")
    better = F.col("best.formal") & ~T.has_legal_form(own)
    return found.withColumn("canonical", F.when(F.col("best").isNull() | better, own).otherwise(F.col("best.name"))).drop("_key", "best")


def canonical_names(names: DataFrame, companies: DataFrame) -> DataFrame:
    """names(parent, name) with `canonical`."""
    return with_canonical(names, companies, "name")


def settle_company(name: Column, canonical: Column, parent: Column, affiliates: Column) -> Column:
    """A site of one company has no name of its own; a group's site has the canonical one; without a parent it is as read."""
    return F.when(parent.isNull(), name).when(~affiliates, None).otherwise(T.filled(canonical))


def title_of(title: Column, by_model: Column, role: Column, split: Column) -> Column:
    """The model's title, else of a split posting `title - role`, else the site's."""
    named = T.filled(T.squeezed(role))
    joined = F.when(T.filled(title).isNull(), named).otherwise(F.concat(title, F.lit(" - "), named))
    return F.coalesce(T.filled(by_model), F.when(split, joined), title)


def overrides_by_posting(overrides: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """(raw_job_id, part, overrides): a map of the fields that people set; blank is kept as blank."""
    rows = overrides.filter(F.col("field_name").isin(list(allowed)))
    pairs = F.collect_list(F.struct("field_name", F.coalesce("value", F.lit(""))))
    return rows.groupBy("raw_job_id", "part").agg(F.map_from_entries(pairs).alias("overrides"))


def overridden(name: str, value: Column) -> Column:
    """What people set, blank as null; else the value."""
    given = F.try_element_at(F.col("overrides"), F.lit(name))
    return F.when(given.isNotNull(), T.filled(given)).otherwise(value)


def settled(fields: dict[str, Column]) -> dict[str, Column]:
    """The last step: head count, years by kind, no far-off deadline, and what follows from them."""
    kind, work = fields["experience_type"], fields["employment_type"]

    def years(c: Column) -> Column:
        return F.when(F.regexp_like(T.stripped(c), F.lit(r"^\d{1,2}$")), T.stripped(c).try_cast("int").cast("string"))

    end = F.when(~dates.no_deadline(fields[END]), fields[END])
    period = F.coalesce(end, F.lit("")) != ""
    least = F.when((kind == "NEWCOMER") | (work == "INTERN"), F.lit("0")).when(kind == "EXPERIENCED", years(fields["experience_min_years"]))
    return {
        **fields,
        "recruitment_headcount": T.first_count(fields["recruitment_headcount"]).cast("string"),
        "experience_min_years": least,
        "experience_max_years": F.when(kind.isin("EXPERIENCED", "BOTH"), years(fields["experience_max_years"])),
        END: end,
        "recruitment_type": F.when(period, "PERIOD").otherwise("ALWAYS_OPEN"),
        "auto_close_enabled": F.when(period, "true").otherwise("false"),
    }


FIELDS = ("title", "company_name", START, END, "recruitment_headcount", "experience_type", "employment_type",
          "experience_min_years", "experience_max_years")
CLASSIFIED = ("recruitment_headcount", "experience_type", "employment_type", "experience_min_years", "experience_max_years")


def normalize(raw: DataFrame, rules: Sequence[Rule], classifications: DataFrame, overrides: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, failures) of raw rows (raw_job_id, source_url, collected date, parent, affiliates, FIELDS, and site_icon and
    cover_image_url where the site has them). A registered logo, the company's or the parent's, comes before the site's icon.

    `classifications`: raw_job_id, part, role, posting_title, dates_by_ai and c_ columns of the
    fields; `overrides`: raw_job_id, part, field_name, value; `companies`: id, name, parent_name, logo_url.
    """
    start, end = dates.period_split(dates.plain_tilde(F.col(START)), dates.plain_tilde(F.col(END)))
    raw = raw.withColumns({START: start, END: dates.without_days_left(end, F.col("collected"))})
    ruled = normalized(raw, rules, FIELDS, "collected")
    failures = ruled.filter("error IS NOT NULL").select("raw_job_id", "error")

    rows = expand_parts(ruled.filter("error IS NULL").drop("error"), classifications.withColumn("_classified", F.lit(True)))
    classified = F.coalesce("_classified", F.lit(False))
    layers = {
        f: overlay(F.col(f), classified, F.col(f"c_{f}"), NO_EXPERIENCE_SAID if f == "experience_type" else None) for f in CLASSIFIED
    }
    layers["company_name"] = fill_company(F.col("company_name"), F.col("c_company_name"))
    for f in (START, END):
        layers[f] = fill_date(F.col(f), F.col(f"c_{f}"), F.col("dates_by_ai"), F.col("collected"), end=f == END)
    rows = rows.withColumns(layers)

    rows = with_canonical(rows, companies, "company_name")
    rows = rows.withColumns(
        {
            "company_name": settle_company(F.col("company_name"), F.col("canonical"), F.col("parent"), F.col("affiliates")),
            "source_url": T.part_url(F.col("source_url"), F.col("part"), F.col("split")),
            "title": title_of(F.col("title"), F.col("posting_title"), F.col("role"), F.col("split")),
        }
    )
    rows = rows.join(overrides_by_posting(overrides, FIELDS), ["raw_job_id", "part"], "left")
    rows = rows.withColumns({f: overridden(f, F.col(f)) for f in FIELDS})
    own = companies.select(F.col("name").alias("company_name"), F.col("logo_url").alias("_own"))
    top = companies.select(F.col("name").alias("parent"), F.col("logo_url").alias("_top"))
    rows = rows.join(own, "company_name", "left").join(top, "parent", "left")
    site = {c: T.filled(F.col(c)) if c in raw.columns else F.lit(None).cast("string") for c in ("site_icon", "cover_image_url")}
    rows = rows.withColumns({"logo_url": F.coalesce(T.filled(F.col("_own")), T.filled(F.col("_top")), site["site_icon"]), "cover_image_url": site["cover_image_url"]})
    last = settled({f: F.col(f) for f in FIELDS})
    return rows.select("raw_job_id", "part", "source_url", F.col("parent").alias("parent_company_name"), "logo_url", "cover_image_url", *[c.alias(n) for n, c in last.items()]), failures


def provenance(edited: Column, by_model: Column, classified: Column, collected: Column) -> Column:
    """Where a field's value comes from, the strongest claim first."""
    return F.when(edited, "edited").when(by_model | classified, "model").when(collected, "site").otherwise("automatic")
