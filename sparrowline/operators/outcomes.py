"""What comes of runs, lessons and deliveries: a run's status with its reason, lessons by week, what goes out again and what is a duplicate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowline.functions.dates import week_number
from sparrowline.functions.text import without_order

SUCCESS, FAILED, TIMEOUT = "success", "failed", "timeout"
# What a run is that gave nothing and says nothing; the reasons it gets.
LIST_EMPTY = "list_empty"
NO_ITEMS, NOTHING_LISTED = "no item was read", "nothing is listed"
# Groups of lessons that are shown one by one; the longest name.
MOST_GROUPS, LONGEST_NAME = 12, 255


def run_outcome(done: Column, skipped: Column, failure: tuple[Column, Column], timed_out: Column, notice: Column, first_failure: tuple[Column, Column]) -> Column:
    """status, error_class, error_message of a run.

    `failure` is what ended the run (class and message; both null: nothing did), `notice` the words by which its list says that
    nothing is listed, `first_failure` the class and message of the first item that could not be read. Over time comes first. A run that did and
    skipped nothing has failed, by its first item's failure or as an empty list; but a list that says so itself is a success, with that
    as its message. A run that ended well has neither class nor message.
    """
    ended = failure[0].isNotNull() | failure[1].isNotNull()
    late = F.coalesce(timed_out, F.lit(False))
    nothing = (F.coalesce(done, F.lit(0)) == 0) & (F.coalesce(skipped, F.lit(0)) == 0)
    quiet = ~ended & ~late & (F.coalesce(notice, F.lit("")) != "")
    status = F.when(quiet, SUCCESS).when(late, TIMEOUT).when(ended | nothing, FAILED).otherwise(SUCCESS)
    unread = first_failure[0].isNotNull() | first_failure[1].isNotNull()
    empty = ~quiet & ~ended & ~late & nothing
    kind = F.when(ended, failure[0]).when(empty & unread, first_failure[0]).when(empty, F.lit(LIST_EMPTY))
    message = (
        F.when(quiet, F.concat(F.lit(f"{NOTHING_LISTED}: "), notice))
        .when(ended, failure[1])
        .when(empty & unread, F.concat(F.lit(f"{NO_ITEMS}: "), F.coalesce(first_failure[1], F.lit(""))))
        .when(empty, F.lit(NO_ITEMS))
    )
    return F.struct(status.alias("status"), kind.alias("error_class"), message.alias("error_message"))


def curriculum(groups: DataFrame, program: str, most: int = MOST_GROUPS, longest: int = LONGEST_NAME) -> DataFrame:
    """program, start_week, end_week, subtitle, place of groups(program, place, name, first_day, last_day, program_start): weeks from the program's start.

    Groups without days, or without a name once its ordinal is gone, are left out. Of a program with more than `most` dated groups
    those that start in one week are one: each name once, in their order, to the last of their ends. Numbered by what comes first.
    """
    start = F.col("program_start")
    dated = groups.filter(F.col("first_day").isNotNull() & F.col("last_day").isNotNull()).select(
        program, "place", F.coalesce(without_order(F.col("name")), F.lit("")).alias("name"),
        week_number(F.col("first_day"), start).alias("first"), week_number(F.col("last_day"), start).alias("last"),
    )
    sizes = dated.groupBy(program).agg((F.count("*") > most).alias("_many"))
    dated = dated.join(sizes, program)
    by = [program, "first"]
    names = dated.filter("_many").groupBy(*by, "name").agg(F.min("place").alias("place"), F.max("last").alias("last"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "name")))
    merged = names.groupBy(*by).agg(F.min("place").alias("place"), F.greatest(F.max("last"), F.first("first")).alias("last"), ordered.alias("_names"))
    merged = merged.withColumn("name", F.array_join(F.transform("_names", lambda n: n["name"]), " · "))
    columns = [program, "place", "name", "first", "last"]
    every = dated.filter("NOT _many").select(*columns).unionByName(merged.select(*columns)).filter("name <> ''")
    return every.select(program, F.col("first").alias("start_week"), F.col("last").alias("end_week"), F.substring("name", 1, longest).alias("subtitle"), "place")


def resend_reasons(pairs: Mapping[str, tuple[Column, Column]], sent: Column) -> Column:
    """Why a row has to go out: `new` where nothing has gone out yet, else the names of what is no longer as it was sent.

    `pairs`: name -> (as it was sent, as it is); null and empty are alike. An empty array: it need not go out.
    """
    changed = [F.when(F.coalesce(old, F.lit("")) != F.coalesce(new, F.lit("")), F.lit(name)) for name, (old, new) in pairs.items()]
    return F.when(~F.coalesce(sent, F.lit(False)), F.array(F.lit("new"))).otherwise(F.array_compact(F.array(*changed)))


def ready_to_send(filled: Column, ends: Column | None, today: Column, attempts: Column, most: int = 3, by_hand: bool = False) -> Column:
    """The row is worked out for the page as it is, has not ended, and has attempts left; those that people send have no limit."""
    out = F.coalesce(filled, F.lit(False))
    if ends is not None:
        out = out & F.coalesce(ends >= today, F.lit(False))
    return out if by_hand else out & (F.coalesce(attempts, F.lit(0)) < most)


def sending(batch: DataFrame, sent: DataFrame, keys: Sequence[str], order: str, succeeds: Column) -> DataFrame:
    """The batch with `outcome` as sending it row by row in its order would have it: sent, failed, or duplicate.

    A row is a duplicate of what has gone out before (`sent` has its keys) and of a row before it that goes out; a row that fails
    leaves its place to the next. Null keys are no one's duplicate. Each key is decided by its first success: an aggregation.
    """
    rows = batch.withColumn("_ok", F.coalesce(succeeds, F.lit(False)))
    whole = [F.col(k).isNotNull() for k in keys]
    complete = whole[0]
    for w in whole[1:]:
        complete = complete & w
    first = rows.filter(complete & F.col("_ok")).groupBy(*keys).agg(F.min(order).alias("_first"))
    gone = sent.select(*keys).distinct().withColumn("_gone", F.lit(True))
    rows = rows.join(first, list(keys), "left").join(gone, list(keys), "left")
    before = F.coalesce(F.col("_gone"), F.lit(False)) | F.coalesce(F.col(order) > F.col("_first"), F.lit(False))
    outcome = F.when(before, "duplicate").when(F.col("_ok"), "sent").otherwise("failed")
    return rows.select(*batch.columns, outcome.alias("outcome"))


# Fixed value: the shortest body that replaces another.
LEAST_BODY = 200


def improved(rows: DataFrame, found: DataFrame, key: str, notes: DataFrame, least: int = LEAST_BODY) -> tuple[DataFrame, DataFrame]:
    """(rows, notes) after bodies have been looked for again: rows(key, body, ...), found(key, body, error), notes(key, outcome).

    A body that is long enough and longer than the one before replaces it; a shorter one changes nothing; where none could be read its
    error stands in the note. A row that is noted already keeps its note: what was first tried is told, and only once.
    """
    new = found.groupBy(key).agg(F.max_by(F.struct("body", "error"), F.length(F.coalesce("body", F.lit("")))).alias("_f"))
    both = rows.join(new, key, "left")
    old_size, new_size = F.length(F.coalesce("body", F.lit(""))), F.length(F.coalesce("_f.body", F.lit("")))
    better = F.coalesce((new_size >= least) & (new_size > old_size), F.lit(False))
    outcome = F.when(F.col("_f.error").isNotNull(), F.concat(F.lit("error: "), F.col("_f.error"))).when(better, "replaced").otherwise("unchanged")
    both = both.withColumns({"_better": better & F.col("_f.error").isNull(), "_outcome": outcome})
    fresh = both.filter(F.col("_f").isNotNull()).select(key, F.col("_outcome").alias("outcome")).join(notes.select(key), key, "left_anti")
    kept = both.withColumn("body", F.when(F.col("_better"), F.col("_f.body")).otherwise(F.col("body"))).select(*rows.columns)
    return kept, notes.select(key, "outcome").unionByName(fresh)
