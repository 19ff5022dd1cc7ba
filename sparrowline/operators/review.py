"""What keeps a posting from going out: all reasons for a look, empty fields, differing deadlines, closed lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowline.functions import dates
from sparrowline.functions import text as T
from sparrowline.operators.predicates import blank, missing_names
from sparrowline.operators.rules import Rule, normalized

SHORT_BODY = 200
END = "recruitment_end_at"
# The fields that a posting needs to go out by itself, in the order in which they are told.
AUTO_FIELDS = (
    "company_name", "title", "industry", "job_field", "job_role", "cover_image_url", "employment_type", "experience_type",
    "education_level", "region", "recruitment_type", "application_method", "recruitment_start_at", "recruitment_end_at",
    "closes_when_filled", "auto_close_enabled",
)


def no_company(c: Mapping[str, Column]) -> Column:
    """Neither a company nor a parent company is named."""
    return blank(c["company_name"]) & blank(c["parent_company_name"])


def auto_missing(c: Mapping[str, Column]) -> Column:
    """Names of AUTO_FIELDS that are empty. A parent company stands in for the company; a deadline is only
    missed where postings have a period."""
    values = {name: c[name] for name in AUTO_FIELDS}
    values["company_name"] = F.when(~no_company(c), "named")
    values[END] = F.when(F.coalesce(c["recruitment_type"] != "PERIOD", F.lit(False)), "none needed").otherwise(c[END])
    return missing_names(values)


def reasons(c: Mapping[str, Column]) -> dict[str, Column]:
    """All reasons for a look at a posting, by name, for filters and for columns alike.

    Beside the posting's fields: delivery_failed, classified, thin_content, career_cap and
    deadline_diff as booleans. Empty fields and the gate's reasons count for classified postings only, as the
    others have nothing yet.
    """
    judged = {
        "no_company": no_company(c),
        "no_title": blank(c["title"]),
        "no_job_role": blank(c["job_role"]),
        "no_deadline": blank(c[END]),
        "no_employment_type": blank(c["employment_type"]),
        "no_experience_type": blank(c["experience_type"]),
        "no_education_level": c["education_level"].isNull(),
        "no_recruitment_type": c["recruitment_type"].isNull(),
        "thin_content": c["thin_content"],
        "career_cap": c["career_cap"],
    }
    return {
        "delivery_failed": c["delivery_failed"],
        "unclassified": ~c["classified"],
        **{name: condition & c["classified"] for name, condition in judged.items()},
        "short_body": F.length(F.trim(F.coalesce(c["body"], F.lit("")))) < SHORT_BODY,
        "deadline_diff": c["deadline_diff"],
    }


def differing_deadlines(postings: DataFrame, suggestions: DataFrame, overrides: DataFrame, collected: Column) -> DataFrame:
    """Postings(raw_job_id, part, recruitment_end_at) for which a day was suggested that is not theirs, unless a person set it.

    `suggestions` and `overrides`: raw_job_id, part, field_name, and value.
    """
    key = ["raw_job_id", "part"]
    ours = suggestions.filter(F.col("field_name") == END).withColumn("_day", dates.loose_day("value", collected))
    days = ours.filter("_day IS NOT NULL").select(*key, "_day").distinct()
    by_hand = overrides.filter(F.col("field_name") == END).select(*key).distinct()
    stored = F.substring(F.coalesce(F.col(END), F.lit("")), 1, 10)
    differing = postings.join(days, key).filter(F.col("_day") != stored).select(*key).distinct()
    return postings.join(differing, key, "left_semi").join(by_hand, key, "left_anti")


def still_open(rows: DataFrame, rules: Sequence[Rule], field: str, today: str, on: str) -> DataFrame:
    """Rows of a list whose deadline, after its rules, is not over by `today`; what cannot be read is open."""
    read = normalized(rows.withColumn("_said", F.col(field)), rules, [field], on)
    day = F.try_to_date(F.substring(T.stripped(F.col(field)), 1, 10), "yyyy-MM-dd")
    over = F.coalesce(F.col("error").isNull() & (day < F.lit(today).cast("date")), F.lit(False))
    return read.filter(~over).withColumn(field, F.col("_said")).drop("_said", "error")
