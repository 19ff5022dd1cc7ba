"""State that is carried from run to run, computed over a history of runs at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparrowline.operators.relational import numbered_within
from sparrowline.sources.scratch import written

MISSES, BASELINE, LEAST_BASELINE, FLOOR = 3, 7, 3, 0.5


def land(batch: DataFrame, known_urls: Sequence[DataFrame], landed: DataFrame, scope: str, url: str, digest: str, order: str) -> DataFrame:
    """New rows of a batch, as taking them one by one in their order would land them: a row whose url a list knows, or
    whose content has landed, adds nothing, and neither does one whose url or content a row before it has landed.

    A row that is first by both its url and its content lands; what it makes known goes, and the rest is looked at again. That ends
    after as many rounds as rows hang together by turns of url and content, which is two as a rule.
    """
    for keys in known_urls:
        batch = batch.join(keys.select(scope, url), [scope, url], "left_anti")
    rest = written(batch.join(landed.select(scope, digest), [scope, digest], "left_anti").select(*batch.columns), "unlanded")
    out = rest.limit(0)
    while not rest.isEmpty():
        by_url = rest.groupBy(scope, url).agg(F.min(order).alias(order))
        by_digest = rest.groupBy(scope, digest).agg(F.min(order).alias(order))
        fresh = rest.join(by_url, [scope, url, order], "left_semi").join(by_digest, [scope, digest, order], "left_semi")
        fresh = written(fresh.dropDuplicates([scope, url]).select(*batch.columns), "landed")
        out = out.unionByName(fresh)
        left = rest.join(fresh.select(scope, url), [scope, url], "left_anti").join(fresh.select(scope, digest), [scope, digest], "left_anti")
        rest = written(left.select(*batch.columns), "unlanded")
    return out


def trust(runs: DataFrame, each: int = 100_000) -> DataFrame:
    """runs(source, run_id, complete, scheduled, status, list_misses, capped, matched) with `reason` why a
    run is not trusted to tell what is missing, null where it is.

    The usual number is the median of the last BASELINE good scheduled runs before it. Each good run
    holds the last BASELINE up to itself, from a bounded frame over good runs; a source is cut into ranges
    of `each` run ids, and a range starts with what the ranges before it carry over.
    """
    good = F.coalesce(F.col("scheduled") & (F.col("status") == "success") & F.col("matched").isNotNull(), F.lit(False))
    up_to = W.rowsBetween(1 - BASELINE, 0)
    before = W.rowsBetween(W.unboundedPreceding, -1)
    empty = F.array().cast("array<" + runs.schema["matched"].dataType.simpleString() + ">")
    rows = runs.withColumn("_range", F.floor(F.col("run_id") / each)).withColumn("_good", good)
    own = F.collect_list("matched").over(up_to.partitionBy("source", "_range", "_good").orderBy("run_id"))
    rows = rows.withColumn("_own", F.when(F.col("_good"), own))
    inside = before.partitionBy("source", "_range").orderBy("run_id")
    tail = F.max_by("_own", F.when(F.col("_good"), F.col("run_id"))).alias("_tail")
    ranges = rows.groupBy("source", "_range").agg(tail).withColumn("_any", F.col("_tail").isNotNull())
    tails = F.flatten(F.collect_list("_tail").over(up_to.partitionBy("source", "_any").orderBy("_range")))
    ranges = ranges.withColumn("_tails", F.when(F.col("_any"), tails))
    carried = F.last("_tails", ignorenulls=True).over(before.partitionBy("source").orderBy("_range"))
    ranges = ranges.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(carried, empty).alias("_carried"))
    rows = rows.withColumn("_past", F.coalesce(F.last("_own", ignorenulls=True).over(inside), empty))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & F.col("_range").eqNullSafe(F.col("_r")))
    past = F.concat("_carried", "_past")
    rows = rows.withColumn("_last", F.sort_array(F.slice(past, F.greatest(F.size(past) - BASELINE + 1, F.lit(1)), BASELINE)))
    last = F.col("_last")
    n = F.size(last)
    median = (F.get(last, F.floor((n - 1) / F.lit(2)).cast("int")) + F.get(last, F.floor(n / F.lit(2)).cast("int"))) / F.lit(2.0)
    reason = (
        F.when(~F.col("complete"), "list is not complete")
        .when(~F.col("scheduled"), "not scheduled")
        .when(F.col("status") != "success", "not successful")
        .when(F.col("list_misses") > 0, "items unread")
        .when(F.col("capped"), "capped")
        .when(n < LEAST_BASELINE, "too few runs to compare")
        .when(F.col("matched") < median * FLOOR, "far fewer than usual")
    )
    return rows.withColumn("reason", reason).select(*runs.columns, "reason")


def missed_state(trusted: DataFrame, postings: DataFrame, seen: DataFrame) -> DataFrame:
    """source, url, missed_runs, last_seen_run, closed: each posting after all trusted runs.

    trusted(source, run_id); postings(source, url, since: the run from which it is watched);
    seen(source, run_id, url). A posting that is seen starts anew and opens again; MISSES trusted
    runs in a row without it close it. What is missing is the number of trusted runs after the
    last sighting, so runs are numbered once and no posting meets all runs.
    """
    runs = written(numbered_within(trusted.select("source", "run_id"), "source", [F.asc("run_id")], "n"), "numbered_runs")
    total = runs.groupBy("source").agg(F.max("n").alias("total"))
    sightings = seen.join(runs, ["source", "run_id"])
    last = sightings.groupBy("source", "url").agg(F.max("n").alias("last_n"), F.max("run_id").alias("last_seen_run"))
    first = postings.alias("p").join(runs.alias("r"), (F.col("p.source") == F.col("r.source")) & (F.col("r.run_id") == F.col("p.since")), "left")
    first = first.select("p.source", "p.url", F.coalesce(F.col("r.n") - 1, F.lit(0)).alias("from_n"))
    out = first.join(total, "source").join(last, ["source", "url"], "left")
    missed = (F.col("total") - F.greatest(F.coalesce("last_n", F.lit(0)), F.col("from_n"))).cast("int")
    return out.select("source", "url", missed.alias("missed_runs"), "last_seen_run", (missed >= MISSES).alias("closed"))


def first_run_cap(items: DataFrame, runs: DataFrame, source: str, order: str, most: int) -> DataFrame:
    """Items up to a cap for sources that have had no new rows yet, all for others."""
    fresh = runs.groupBy(source).agg((F.max("new_count") > 0).alias("_done"))
    rows = numbered_within(items, source, [F.asc(order)], "_place").join(fresh, source, "left")
    return rows.filter(F.coalesce("_done", F.lit(False)) | (F.col("_place") <= most)).drop("_done", "_place")


def unsent(status: Column, attempts: Column, most: int = 3) -> Column:
    """Never sent, or failed with attempts left."""
    return status.isNull() | ((status == "failed") & (attempts < most))


def one_of_each(batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Within a batch, the first of those that would be duplicates once one is sent."""
    others = [c for c in batch.columns if c not in keys]
    found = batch.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r"))
    return found.select(*keys, "_r.*")


def next_slice(df: DataFrame, key: str, cursor: int, size: int) -> DataFrame:
    """The next rows after a cursor; from the start again when none are left."""
    rows = df.filter(F.col(key) > cursor)
    return (df if rows.isEmpty() else rows).orderBy(key).limit(size)


def judge_once(df: DataFrame, url: Column, judge) -> DataFrame:
    """A dear judgement made once for each url and shared by all rows that have it."""
    keyed = df.withColumn("_url", url)
    return keyed.join(judge(keyed.select("_url").distinct()), "_url", "left").drop("_url")


def needs_work(done_hash: Column, page_hash: Column, ended: Column) -> Column:
    """The page has changed since it was last worked on, and it has not ended."""
    return ~done_hash.eqNullSafe(page_hash) & ~F.coalesce(ended, F.lit(False))


def reusable(targets: DataFrame, results: DataFrame, on: Sequence[str], most_failures: int) -> DataFrame:
    """Targets with `action`: reuse where a result has the same keys, give_up after too many failures, else work."""
    known = results.select(*on).distinct().withColumn("_has", F.lit(True))
    rows = targets.join(known, list(on), "left")
    action = F.when(F.col("_has"), "reuse").when(F.col("failures") >= most_failures, "give_up").otherwise("work")
    return rows.withColumn("action", action).drop("_has")


def stops_at(results: DataFrame, scope: str, order: str, failed: Column, in_a_row: int) -> DataFrame:
    """Results of each scope up to where so many in a row have failed."""
    w = W.partitionBy(scope).orderBy(order)
    good = F.sum((~failed).cast("int")).over(w)
    run = F.sum(failed.cast("int")).over(W.partitionBy(scope, "_good").orderBy(order))
    rows = results.withColumn("_good", good).withColumn("_run", run)
    stopped = F.max((F.col("_run") >= in_a_row).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_stop", stopped).filter("coalesce(_stop, 0) = 0").drop("_good", "_run", "_stop")


def gate_rounds(rows: DataFrame, caught, again, rounds: int = 2) -> DataFrame:
    """Rows that a gate catches are worked on again, `rounds` times at most: (rows, attempts, caught)."""
    rows = rows.withColumn("attempts", F.lit(0))
    for _ in range(rounds):
        hit = F.coalesce(caught(rows), F.lit(False))
        redone = again(rows)
        rows = rows.select(
            *[F.when(hit, redone[c]).otherwise(F.col(c)).alias(c) for c in redone], *[c for c in rows.columns if c not in redone and c != "attempts"],
            (F.col("attempts") + hit.cast("int")).alias("attempts"),
        )
    return rows.withColumn("caught", F.coalesce(caught(rows), F.lit(False)))
