"""A posting as it is sent on: one JSON text a row, with all fields of the contract, empty ones as null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowline.functions import text as T

# Fields of the contract with the column they come from, by kind.
TEXTS = {"title": "title", "industry": "industry", "coverImageUrl": "cover_image_url", "logoUrl": "logo_url", "applyEmail": "application_email",
         "inquiryEmail": "inquiry_email", "sourceUrl": "source_url", "sourceHtml": "source_html",
         "companyAndTeamIntroduction": "company_and_team_introduction", "responsibilities": "responsibilities", "qualifications": "qualifications",
         "preferredQualifications": "preferred_qualifications", "compensation": "compensation", "benefits": "benefits",
         "hiringProcess": "hiring_process", "recruitmentNotice": "recruitment_notice"}
CHOICES = {"employmentType": "employment_type", "experienceType": "experience_type", "educationLevel": "education_level", "region": "region",
           "recruitmentType": "recruitment_type", "applicationMethod": "application_method"}
COUNTS = {"experienceMinYears": "experience_min_years", "recruitmentHeadcount": "recruitment_headcount"}
MOMENTS = {"recruitmentStartAt": "recruitment_start_at", "recruitmentEndAt": "recruitment_end_at"}
FLAGS = {"closesWhenFilled": "closes_when_filled", "autoCloseEnabled": "auto_close_enabled"}


def fields(c: Mapping[str, Column], allowed: Mapping[str, Sequence[str]], sub_regions: Mapping[str, Sequence[str]], roles: Mapping[tuple[str, str], tuple[str, str]]) -> dict[str, Column]:
    """Every field of the contract. `allowed`: choices by column; `sub_regions` by region; `roles`: the contract's names
    of (field, role). What is no choice is null; a posting that is always open has no end."""
    company, parent = T.filled(c["company_name"]), T.filled(c["parent_company_name"])
    named = F.coalesce(company, parent)
    pair = F.concat_ws(T.UNIT, T.filled(c["job_field"]), T.filled(c["job_role"]))
    names = {T.UNIT.join(k): v for k, v in roles.items()}

    def role(i: int) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v[i])]), pair)

    inside = [(c["region"] == region) & c["sub_region"].isin(*subs) for region, subs in sub_regions.items()]
    out = {"companyName": named, "parentCompanyName": F.when(parent != named, parent), "jobField": role(0), "jobRole": role(1)}
    out |= {name: T.filled(c[column]) for name, column in TEXTS.items()}
    out |= {name: T.as_choice(c[column], allowed[column]) for name, column in CHOICES.items()}
    out["subRegion"] = F.when(F.coalesce(F.greatest(*inside, F.lit(False)), F.lit(False)), c["sub_region"])
    out |= {name: T.as_count(c[column]) for name, column in COUNTS.items()}
    out |= {name: T.as_moment(c[column]) for name, column in MOMENTS.items()}
    out |= {name: T.as_flag(c[column]) for name, column in FLAGS.items()}
    out["recruitmentEndAt"] = F.when(F.coalesce(out["recruitmentType"] != "ALWAYS_OPEN", F.lit(True)), out["recruitmentEndAt"])
    return out


def payload(c: Mapping[str, Column], *contract) -> Column:
    """The fields as JSON, by name."""
    found = fields(c, *contract)
    return F.to_json(F.struct(*[found[n].alias(n) for n in sorted(found)]), {"ignoreNullFields": "false"})
