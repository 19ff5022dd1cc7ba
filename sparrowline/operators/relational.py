"""Joins, reports, duplicate groups, run history and paging as DataFrame functions."""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparrowline.sources.scratch import written


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of each key the row with the largest `order`, as one aggregation without a sort."""
    others = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("_row"))
    return found.select(*keys, "_row.*")


def with_flag(df: DataFrame, keys: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Whether the row's key is among `keys`, joined once and usable in any predicate."""
    return df.join(keys.select(*on).distinct().withColumn(name, F.lit(True)), list(on), "left").withColumn(
        name, F.coalesce(name, F.lit(False))
    )


def zero_filled(domain: DataFrame, facts: DataFrame, key: str, name: str) -> DataFrame:
    """Counts over a fixed domain; values that do not occur count 0."""
    counts = facts.groupBy(key).agg(F.count("*").alias(name))
    return domain.select(key).join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def fill_rates(df: DataFrame, filled: Mapping[str, Column]) -> DataFrame:
    """field, filled, total, percent (half to even; 0 of nothing is 0): one pass, then unpivoted."""
    wide = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(f) for f, c in filled.items()])
    long = wide.unpivot("total", list(filled), "field", "filled")
    percent = F.when(F.col("total") == 0, 0).otherwise(F.bround(100.0 * F.col("filled") / F.col("total"), 0))
    return long.select("field", "filled", "total", percent.cast("long").alias("percent"))


def duplicate_groups(df: DataFrame, keys: Sequence[str], present: Column) -> DataFrame:
    """Usable keys with several rows: the keys and their number of rows."""
    return df.filter(present).groupBy(*keys).agg(F.count("*").alias("size")).filter("size > 1")


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Rows numbered from 1 in an order that no two rows share.

    Rows are sorted over ranges and written; a row's number is its place in its range and what
    all ranges before hold, so no task gets more than a range.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id() % (1 << 33)}), "ranges")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    found = dealt.join(F.broadcast(starts.drop("_n")), "_range")
    return found.withColumn(name, (F.col("_before") + F.col("_place") + 1).cast("long")).drop("_range", "_place", "_before")


def numbered_within(df: DataFrame, key: str, order: Sequence[Column], name: str) -> DataFrame:
    """Rows numbered from 1 inside their key, in an order that no two rows of a key share. No key's rows meet in one task.

    Rows are sorted over ranges of key and order and written; a row's number is its place among the key's rows in its range and what
    the key has in the ranges before. Only a row for each key and range is summed up by key.
    """
    by = [F.asc_nulls_first(key), *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = written(dealt.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id() % (1 << 33)}), "ranges")
    before = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_part")).agg(F.count("*").alias("_n"), F.min("_place").alias("_low"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).drop("_n", "_low")
    found = dealt.join(parts, dealt[key].eqNullSafe(parts["_key"]) & (F.col("_range") == F.col("_part")))
    return found.withColumn(name, (F.col("_before") + F.col("_place") + 1).cast("long")).select(*df.columns, name)


def number_groups(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups numbered from 1, largest first, then by key. Rows are groups, not members."""
    return numbered(groups, [F.desc("size"), *(F.asc(k) for k in keys)], "group_no")


def duplicates_of_others(df: DataFrame, same: Sequence[str], differs: str) -> DataFrame:
    """Rows for which another row has null-safely equal keys but another value of `differs`.

    A key has another value exactly if it has two distinct ones, so the smallest and largest by
    key decide; no row meets the others of its key.
    """
    by = df.groupBy(*same).agg(F.min(differs).alias("_low"), F.max(differs).alias("_high")).filter("_low <> _high")
    right = by.select(*[F.col(c).alias(f"_{c}") for c in same])
    equal = [df[c].eqNullSafe(right[f"_{c}"]) for c in same]
    return df.filter(F.col(differs).isNotNull()).join(right, equal, "left_semi")


def streaks(runs: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """Length of the unbroken series of failures that ends in each key's last run.

    It is the number of runs after the last one that did not fail: two aggregates and a join, no sort.
    """
    last_good = runs.groupBy(key).agg(F.max(F.when(~failed, F.col(order))).alias("_good"))
    after = runs.join(last_good, key).filter(F.col("_good").isNull() | (F.col(order) > F.col("_good")))
    counted = after.groupBy(key).agg(F.count("*").alias("streak"))
    return last_good.select(key).join(counted, key, "left").withColumn("streak", F.coalesce("streak", F.lit(0)))


def severity(streak: Column, threshold: int) -> Column:
    return F.when(streak >= threshold, "stopped").when(streak >= 2, "warning").when(streak == 1, "notice").otherwise("ok")


def last_n(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """Each key's last n rows (numbered by `_place`)."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_place") <= n)


def cost_by_day(calls: DataFrame, prices: DataFrame, tz: str) -> DataFrame:
    """Calls grouped by local day, feature and model, with cost where the model has a price.

    `calls`: at (UTC timestamp_ntz), feature, model, ok, input_tokens, output_tokens; `prices`:
    model, input_price, output_price by a million tokens.
    """
    local = F.from_utc_timestamp(F.col("at").cast("timestamp"), tz)
    grouped = calls.groupBy(F.to_date(local).alias("day"), "feature", "model").agg(
        F.count("*").alias("calls"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    cost = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6
    return grouped.join(prices, "model", "left").withColumn("cost", cost)


def first_of_priority(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of several sources by key; where several have one, the last source counts."""
    ranked = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    every = ranked[0]
    for f in ranked[1:]:
        every = every.unionByName(f)
    return latest(every, [key], "_source").drop("_source")


def offset_page(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page of a sorted list; page numbers out of range become the nearest page."""
    total = df.count()
    pages = max(1, -(-total // size))
    page = min(max(1, page), pages)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


LIMIT, MOST = 100, 500


def encode_cursor(moment: str, row_id: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"t": moment, "id": row_id}).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, int]:
    """The position; ValueError if the text is damaged."""
    try:
        said = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        datetime.fromisoformat(said["t"])
        return said["t"], int(said["id"])
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("the cursor is damaged") from e


def keyset_page(df: DataFrame, moment: str, row_id: str, after: tuple[str, int] | None, limit: int | None) -> DataFrame:
    """The next rows after a position in (moment, id) order, one more than the page to show if there are others."""
    n = min(max(1, limit or LIMIT), MOST)
    if after is not None:
        t, i = F.lit(after[0]).cast("timestamp_ntz"), after[1]
        df = df.filter((F.col(moment) > t) | ((F.col(moment) == t) & (F.col(row_id) > i)))
    return df.orderBy(moment, row_id).limit(n + 1)


def read_feed(df: DataFrame, moment: str, row_id: str, cursor: str | None, limit: int | None) -> tuple[list, bool, str | None]:
    """A page of at most `MOST` rows, whether there are more, and the cursor to go on from.

    An empty page gives back the cursor it was asked with.
    """
    n = min(max(1, limit or LIMIT), MOST)
    rows = keyset_page(df, moment, row_id, decode_cursor(cursor) if cursor else None, n).collect()
    page, more = rows[:n], len(rows) > n
    return page, more, encode_cursor(str(page[-1][moment]), page[-1][row_id]) if page else cursor


def acknowledge(rows: DataFrame, asked: DataFrame, key: str, at: str, moment: str) -> tuple[DataFrame, DataFrame]:
    """Sets `at` where it is null and asked for; also gives each asked key's outcome: marked, already or missing."""
    asked = asked.select(key).distinct()
    outcome = asked.join(rows.select(key, at), key, "left").select(
        key,
        F.when(F.col(at).isNotNull(), "already").otherwise("marked").alias("_outcome"),
    )
    known = rows.select(key).withColumn("_known", F.lit(True))
    outcome = outcome.join(known, key, "left").select(
        key, F.when(F.col("_known").isNull(), "missing").otherwise(F.col("_outcome")).alias("outcome")
    )
    marked = with_flag(rows, asked, [key], "_asked")
    stamp = F.lit(moment).cast(dict(rows.dtypes)[at])
    new = marked.withColumn(at, F.when(F.col("_asked") & F.col(at).isNull(), stamp).otherwise(F.col(at))).drop("_asked")
    return new, outcome
