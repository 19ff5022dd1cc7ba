"""Outcomes of runs, lessons and deliveries case by case, sending against a plain loop."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparrowline.operators import outcomes as O

N = None


@pytest.mark.parametrize(
    "given,want",
    [
        ((0, 0, N, N, N, N, N, N), ("failed", "list_empty", O.NO_ITEMS)),
        ((0, 0, N, N, False, "none open", N, N), ("success", N, f"{O.NOTHING_LISTED}: none open")),
        ((0, 3, N, N, False, "", "x", "y"), ("success", N, N)),
        ((2, 0, N, N, False, N, "x", "one was bad"), ("success", N, N)),
        ((0, 0, N, N, False, N, "detail_empty", "no body"), ("failed", "detail_empty", f"{O.NO_ITEMS}: no body")),
        ((5, 0, "fetch", "no answer", False, "none open", N, N), ("failed", "fetch", "no answer")),
        ((0, 0, N, "unknown", False, N, N, N), ("failed", N, "unknown")),
        ((9, 9, N, N, True, "none open", N, N), ("timeout", N, N)),
        ((N, N, N, N, N, N, N, N), ("failed", "list_empty", O.NO_ITEMS)),
    ],
)
def test_outcomes_of_runs(spark, given, want):
    df = spark.createDataFrame([given], "done int, skipped int, fc string, fm string, late boolean, notice string, ic string, im string")
    c = F.col
    row = df.select(O.run_outcome(c("done"), c("skipped"), (c("fc"), c("fm")), c("late"), c("notice"), (c("ic"), c("im"))).alias("o")).first().o
    assert tuple(row) == want


def test_lessons_are_shown_one_by_one_until_they_are_too_many(spark):
    start = dt.date(2024, 1, 1)

    def day(n):
        return start + dt.timedelta(days=n)

    rows = [("few", i, f"{i}차시 Lesson {i}", day(7 * i), day(7 * i + 8), start) for i in range(12)]
    rows += [("few", 90, "no days", N, N, start), ("few", 91, "  ", day(0), day(0), start), ("few", 92, N, day(0), day(1), start)]
    rows += [("many", i, "3차시 A" if i % 2 else "B", day(i), day(i + (20 if i == 3 else 0)), start) for i in range(15)] + [("before", 1, "4차시", day(-9), day(-3), start)]
    kind = "program string, place int, name string, first_day date, last_day date, program_start date"
    found = O.curriculum(spark.createDataFrame(rows, kind), "program", most=14).collect()
    few = sorted((r.place, r.start_week, r.end_week, r.subtitle) for r in found if r.program == "few")
    assert few == [(i, i + 1, i + 2, f"Lesson {i}") for i in range(12)]
    assert sorted((r.start_week, r.end_week, r.subtitle) for r in found if r.program == "many") == [(1, 4, "B · A"), (2, 2, "A · B"), (3, 3, "B")]
    assert [(r.start_week, r.end_week, r.subtitle) for r in found if r.program == "before"] == [(1, 1, "4차시")]
    assert O.curriculum(spark.createDataFrame([], kind), "program").collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_sending_is_one_row_after_the_other(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", N]), rng.choice(["t", "u"]), rng.choice([True, True, False, N])) for i in range(60)]
    gone, want = {("b", "u")}, {}
    for i, company, title, ok in rows:
        if (company, title) in gone:
            want[i] = "duplicate"
            continue
        want[i] = "sent" if ok else "failed"
        if ok and company is not N:
            gone.add((company, title))
    batch = spark.createDataFrame(rows, "id int, company string, title string, ok boolean").repartition(3)
    before = spark.createDataFrame([("b", "u"), ("b", "u")], "company string, title string")
    assert {r.id: r.outcome for r in O.sending(batch, before, ["company", "title"], "id", F.col("ok")).collect()} == want


def test_each_trigger_alone(spark):
    df = spark.createDataFrame([("a", "a", N, ""), ("a", "b", "", N), ("a", "a", "l", N), (N, "", "l", "l")], "h1 string, h2 string, l1 string, l2 string")
    pairs = {"hash": (F.col("h1"), F.col("h2")), "logo": (F.col("l1"), F.col("l2"))}
    assert [r.r for r in df.select(O.resend_reasons(pairs, F.lit(True)).alias("r")).collect()] == [[], ["hash"], ["logo"], []]
    assert df.select(O.resend_reasons(pairs, F.lit(N).cast("boolean")).alias("r")).first().r == ["new"]
    today = F.lit("2024-01-01").cast("date")
    ready = spark.range(1).select(
        O.ready_to_send(F.lit(True), today, today, F.lit(2)).alias("a"), O.ready_to_send(F.lit(True), today, today, F.lit(3)).alias("b"), O.ready_to_send(F.lit(True), N, today, F.lit(9), by_hand=True).alias("c"),
        O.ready_to_send(F.lit(True), F.lit(N).cast("date"), today, F.lit(0)).alias("d"), O.ready_to_send(F.lit(N).cast("boolean"), N, today, F.lit(0)).alias("e"),
    ).first()
    assert tuple(ready) == (True, False, True, False, False)
