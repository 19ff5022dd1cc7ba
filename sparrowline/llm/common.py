"""What several corpus operators share: column picking, shared storage, word counts, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparrowline.sources.scratch import new_folder, shared_folder, written  # noqa: F401  operators take them from here

#: A word is a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, found by exact spelling and position.

    Extra columns never get in the way, not even `TEXT` beside `text`. A missing
    column is an error.
    """
    at = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    by_position = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return by_position.select(*[F.col(f"_{at[n]}").alias(n) for n in names])


def word_count(text: Column) -> Column:
    """Number of words of the whole text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quantised(size: Column, bits: int) -> Column:
    """The number with all but its leading `bits` binary digits set to zero."""
    drop = F.greatest(F.length(F.bin(size)) - bits, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def matched(rows: DataFrame, table: DataFrame, by: list[str], n: str, share: int = 1000) -> DataFrame:
    """Inner join of rows with a table that has one row a key, with the number `n` of the key's rows.

    A key with more than 1/share of all rows would fill a task by itself. There are fewer than
    `share` such keys whatever the data, so they are broadcast and their rows stay where they are;
    only the rows of other keys are shuffled. Keys must not be null. Both sides are read twice, so
    they should be cheap to read.
    """
    many = F.col(n) * share > F.lit(rows.count())
    large = table.filter(many)
    others = rows.join(F.broadcast(large.select(*by)), by, "left_anti").join(table.filter(~many), by)
    return rows.join(F.broadcast(large), by).unionByName(others)


def one_of_twins(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """One row, whole, for each value of the keys: that with the smallest hash of its columns `names`, so that
    reruns take the same. An aggregation, which combines in each task first."""
    columns = F.struct(*names)
    return rows.groupBy(*keys).agg(F.min_by(columns, F.xxhash64(F.to_json(columns))).alias("_one")).select("_one.*")


def ranked(df: DataFrame, key: str, coarse: str, tie: Column, fine: list[Column], cell_rows: int = 4096) -> DataFrame:
    """Adds `rank`: the row's place, from 1, in its group `key`, no group ever being in one task.

    Rows of a group are ordered by `coarse`, then by a hash cell, then by `fine`. A cell
    (key, coarse, hash) holds about `cell_rows` rows, whatever the size of the group, so a key
    with a third of all rows is spread over as many cells as it needs. Only counts of cells are
    summed up by key. `df` is read several times. `key` and `coarse` must not hold nulls; `tie` is a non-negative integer.
    """
    by = [key, coarse]
    counts = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    cells = F.ceil(F.col("_rows") / F.lit(cell_rows)).cast("long")
    dealt = matched(df, counts, by, "_rows").withColumn("_cell", tie % cells).drop("_rows")
    before = W.partitionBy(key).orderBy(coarse, "_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*by, "_cell")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = W.partitionBy(*by, "_cell").orderBy(*fine)
    return (
        dealt.join(starts, [*by, "_cell"])
        .withColumn("rank", F.col("_before") + F.row_number().over(inside))
        .drop("_before", "_cell")
    )
