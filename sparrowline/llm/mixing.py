"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected `target / source_size` times in the mix. Within the
source, documents stand in one fixed order, the expected copies are summed up along it, one
random offset of the source is added, and a document is taken once for each integer that its
own interval of the sum crosses. The order is by size, so that a source's taken words differ
from its target by about one document's size.

Defined cases: a null text has size 0; a null source is a source of its own, last in the order
of weights (sources are a dimension: a row each passes one window, so a column of hosts is not one); repeated rows are documents of their own; an empty table gives an empty result; a
source of size 0 has target 0 and gives nothing; a null doc_id is kept as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparrowline.llm.common import one_of_twins, pick, quantised, ranked, word_count, written


def hash_number(text: Column) -> Column:
    """A number from 0 to 2^32 - 1 out of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def tie(doc_id: str, text: str) -> Column:
    """The number that deals rows of a source and size to cells: of id and text, so that rows without id, or with one id, spread as well."""
    return hash_number(F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row a source (column _key): source_size, target, offset.

    Sources take the weights in turn, by code point and null last. `share` times all sizes is
    dealt by weight; a source takes `most` times its size at the most, and what it leaves is
    dealt again among the others. Sorted by cap/weight, the sources that stop at their cap come
    first, so one running sum finds the level at which all is dealt. The table has a row for each
    source; no documents meet in these windows.
    """
    per = sized.groupBy("_key").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("_key") == "n", "_key")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("_cap") / F.col("_w"), "_key").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(F.col("_cap") / F.col("_w"), "_key").rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(order), F.lit(0.0))
    per = per.withColumn("_level", left / F.sum("_w").over(after))
    at_cap = F.col("_cap") / F.col("_w") <= F.col("_level")
    target = F.when(at_cap, F.col("_cap")).otherwise(F.max("_level").over(everything) * F.col("_w"))
    return per.select("_key", "source_size", F.least(target, "_cap").alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """The mix of documents(doc_id, text, source): a row for each row of `docs`.

    Returns doc_id, text_hash (XXH64 of the text, to find the row again), size, source_size,
    target, copies and taken (copies times size). Only sizes and ids are shuffled, never texts;
    they are written to the shared folder once.
    """
    sized = written(
        pick(docs, "doc_id", "text", "source").select(
            "doc_id",
            F.xxhash64("text").alias("text_hash"),
            tie("doc_id", "text").alias("_tie"),
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_key"),
            word_count(F.col("text")).alias("size"),
        ),
        "sizes",
    )
    ordered = ranked(
        sized.withColumn("_large_first", -quantised(F.col("size"), 7)),
        "_key",
        "_large_first",
        F.col("_tie"),
        [F.desc("size"), F.asc_nulls_first("doc_id"), F.col("_tie"), F.col("text_hash")],
    )
    offset = hash_number(F.concat(F.lit(f"mix {seed} "), F.col("_key"))) / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = source_targets(sized, weights, share, most).withColumns({"_rate": rate, "_offset": offset})
    crossed = F.floor(F.col("_rate") * F.col("rank") + F.col("_offset")) - F.floor(
        F.col("_rate") * (F.col("rank") - 1) + F.col("_offset")
    )
    copies = F.least(crossed, F.ceil("_rate")).cast("long")
    return ordered.join(rates, "_key").select(
        "doc_id", "text_hash", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it (not at all, once or more)."""
    took = mix(docs, **options)
    # Copies of rows that are equal in id and text are added up; one of these rows, the same at each run, is emitted for all.
    took = written(
        took.groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")), "mix"
    )
    names = [f"_{i}" for i in range(len(docs.columns))]
    key_id, key_text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = docs.toDF(*names).withColumn("_hash", F.xxhash64(key_text))
    same = key_id.eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))
    rows = rows.join(took.filter("_copies > 0"), same)
    if not took.filter("_copies > 0 AND _rows > 1").isEmpty():
        twins = one_of_twins(rows.filter("_rows > 1"), [*names, "_copies"], ["doc_id", "text_hash"])
        rows = rows.filter("_rows = 1").select(*names, "_copies").unionByName(twins)
    return (
        rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .select(*names)
        .toDF(*docs.columns)
    )
