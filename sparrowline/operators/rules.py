"""Normalization rules: data that is checked on the driver and compiled to one expression a field.

A rule takes the value that the one before it gave. Once the value is empty, no later rule
runs. A row whose value a rule cannot read keeps its error and drops out; others go on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowline.functions import dates, patterns
from sparrowline.functions import text as T
from sparrowline.functions.html import html_text

TYPES = ("mapping", "regex", "trim", "date_parse", "html_text")
KEYS = {
    "mapping": {"map", "default"},
    "regex": {"pattern", "replacement"},
    "trim": {"collapse", "chars"},
    "date_parse": {"formats", "output_format"},
    "html_text": set(),
}
#: Time of a day alone, by field.
BOUNDARY = {"recruitment_start_at": "00:00:00", "recruitment_end_at": "23:59:59"}


class RuleError(ValueError):
    """A rule that cannot be used; `reason` is type, config or value."""

    def __init__(self, reason: str, message: str):
        super().__init__(message)
        self.reason = reason


@dataclass(frozen=True)
class Rule:
    id: int
    field_name: str
    rule_type: str
    priority: int
    config: Mapping = field(default_factory=dict)
    enabled: bool = True


def read_rule(row: Mapping) -> Rule:
    """A checked rule of a table row (config as JSON text)."""
    if row["rule_type"] not in TYPES:
        raise RuleError("type", f"rule {row['id']}: unknown type {row['rule_type']}")
    try:
        config = json.loads(row["rule_config_json"] or "{}")
    except ValueError as e:
        raise RuleError("config", f"rule {row['id']}: {e}") from e
    if not isinstance(config, dict) or set(config) - KEYS[row["rule_type"]]:
        raise RuleError("config", f"rule {row['id']}: keys may be {sorted(KEYS[row['rule_type']])}")
    rule = Rule(row["id"], row["field_name"], row["rule_type"], row["priority"], config, bool(row["enabled"]))
    _check(rule)
    return rule


def _check(rule: Rule) -> None:
    c = rule.config
    try:
        if rule.rule_type == "mapping" and not isinstance(c.get("map"), dict):
            raise ValueError("a map is needed")
        if rule.rule_type == "regex":
            patterns.java_pattern(c["pattern"])
            patterns.java_replacement(c["pattern"], c.get("replacement", ""))
        if rule.rule_type == "date_parse":
            if not c.get("formats"):
                raise ValueError("formats are needed")
            for f in c["formats"]:
                dates.spark_format(f)
                if not re.search("%[Yy]", f):
                    raise ValueError(f"{f} has no year")
            dates.spark_format(c.get("output_format", "%Y-%m-%d %H:%M:%S"))
    except (ValueError, KeyError, re.error) as e:
        raise RuleError("value", f"rule {rule.id}: {e}") from e


def _apply(rule: Rule, v: Column, collected: Column) -> tuple[Column, Column]:
    """The rule's value, and whether it failed."""
    c, fine = rule.config, F.lit(False)
    if rule.rule_type == "mapping":
        table = F.create_map(*[F.lit(x) for pair in (c["map"] or {"": ""}).items() for x in pair])
        return F.coalesce(F.try_element_at(table, v), F.lit(c["default"]) if c.get("default") is not None else v), fine
    if rule.rule_type == "regex":
        return patterns.substituted(v, c["pattern"], c.get("replacement", "")), fine
    if rule.rule_type == "trim":
        out = F.regexp_replace(v, f"[{patterns.SPACE}]+", " ") if c.get("collapse") else v
        return F.btrim(out, F.lit(c.get("chars") or T.SPACES)), fine
    if rule.rule_type == "html_text":
        return html_text(v), fine
    boundary = BOUNDARY.get(rule.field_name)
    moment = dates.parse_formats(v, c["formats"], boundary)
    if boundary:
        loosely = dates.loose_moment(v, collected, end=rule.field_name.endswith("end_at")).try_cast("timestamp_ntz")
        moment = F.coalesce(moment, loosely)
    return F.date_format(moment, dates.spark_format(c.get("output_format", "%Y-%m-%d %H:%M:%S"), padded=True)), moment.isNull()


def ordered(rules: Iterable[Rule], field_name: str) -> list[Rule]:
    return sorted((r for r in rules if r.enabled and r.field_name == field_name), key=lambda r: (r.priority, r.id))


def normalized(df: DataFrame, rules: Sequence[Rule], fields: Sequence[str], collected: str) -> DataFrame:
    """The fields after their rules, and `error`: the first rule that failed, as text.

    Each rule is one projection of its field (value and error together), so what it reads is
    computed once. Fields do not depend on each other.
    """
    ruled = {name: found for name in fields if (found := ordered(rules, name))}
    for name, found in ruled.items():
        df = df.withColumn(name, F.struct(F.coalesce(F.col(name).cast("string"), F.lit("")).alias("v"), F.lit(None).cast("string").alias("error")))
        for rule in found:
            old, error = F.col(f"{name}.v"), F.col(f"{name}.error")
            new, failed = _apply(rule, old, F.col(collected))
            told = F.when(F.coalesce(failed, F.lit(True)), F.lit(f"{name}: {rule.rule_type} {rule.id}"))
            step = F.struct(F.coalesce(new, F.when(failed, old), F.lit("")).alias("v"), told.alias("error"))
            df = df.withColumn(name, F.when((old != "") & error.isNull(), step).otherwise(F.col(name)))
    values = {f: F.nullif(F.col(f"{f}.v") if f in ruled else F.col(f).cast("string"), F.lit("")) for f in fields}
    return df.withColumns(values | {"error": F.coalesce(F.lit(None).cast("string"), *[F.col(f"{f}.error") for f in ruled])})


def traced(value: Column, rules: Sequence[Rule], field_name: str, collected: Column, draft: Rule | None = None) -> Column:
    """The value after each rule in order, an unsaved draft among them: array of (rule, value)."""
    steps, v = [], F.coalesce(value, F.lit(""))
    for rule in ordered([*rules, *([draft] if draft else [])], field_name):
        new, _ = _apply(rule, v, collected)
        v = F.when(v != "", F.coalesce(new, F.lit(""))).otherwise(v)
        steps.append(F.struct(F.lit(rule.id).alias("rule"), v.alias("value")))
    return F.array(*steps)
