"""Packing documents of like length: optimal length buckets, token-budget batches inside each.

A batch pads its documents to the upper length of their bucket. The bucket boundaries come
from a dynamic program over the histogram of all lengths and make the padding of the whole
table as small as that many buckets allow, at every length. The histogram has a row for each length that occurs; n
lengths need n * n / 2 words at least, so it grows with the square root of the corpus at most:
10^13 words have fewer than 5 million different lengths, 80 MB on the driver.

Lengths are numbers of words between white space, here called tokens; `length` takes any other
count as a column.

Defined cases: a null text has length 0; documents longer than the token budget are batches of
their own and are kept whole; equal lengths never fall into two buckets; repeated rows are
documents of their own, numbered by `copy`; a null length counts as 0; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparrowline.llm.common import pick, ranked, word_count, written


def _least(best: np.ndarray, count: np.ndarray, total: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least of best[i] plus the padding of cells i..j-1 as one more bucket, over i < j, and its first i.

    The best i never moves left as j moves right. So every second j is solved once the others
    are, between the best of its neighbours; all of a round at once.
    """
    n = len(upper)
    new, split = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    stride = 1 << n.bit_length()
    while stride > 1:
        half = stride // 2
        j = np.arange(half, n + 1, stride)
        left = split[j - half]
        after = np.minimum(j + half, n)
        right = np.minimum(np.where(j + half <= n, split[after], n - 1), j - 1)
        sizes = right - left + 1
        starts = np.cumsum(sizes) - sizes
        i = np.arange(int(sizes.sum())) + np.repeat(left - starts, sizes)
        at = np.repeat(j, sizes)
        cost = best[i] + (count[at] - count[i]) * upper[at - 1] - (total[at] - total[i])
        new[j] = np.minimum.reduceat(cost, starts)
        hits = np.flatnonzero(cost == np.repeat(new[j], sizes))
        split[j] = i[hits[np.searchsorted(hits, starts)]]
        stride = half
    return new, split


def boundaries(upper, counts, totals, buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets with the least padding.

    Cells are in ascending order: the largest length in each, how many documents it holds, and the sum
    of their lengths. Cells i..j as one bucket pad count * upper[j] - total.
    """
    n = len(upper)
    if not n:
        return []
    upper = np.asarray(upper, dtype=np.int64)
    count = np.r_[0, np.cumsum(np.asarray(counts, dtype=np.int64))]
    total = np.r_[0, np.cumsum(np.asarray(totals, dtype=np.int64))]
    best = np.r_[0, count[1:] * upper - total[1:]]  # best[j]: the cells before j as one bucket
    splits = [np.zeros(n + 1, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        best, split = _least(best, count, total, upper)
        splits.append(split)
    out, j = [], n
    for split in reversed(splits):
        out.append(int(upper[j - 1]))
        j = int(split[j])
        if j == 0:
            break
    return out[::-1]


def _placed(sized: DataFrame, buckets: int, token_budget: int) -> DataFrame:
    """sized(doc_id, _hash, n_tokens, ...) with bucket, padded_length, batch, slot, padding and copy."""
    found = sized.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toArrow()
    lengths, counts = found["n_tokens"].to_numpy(), found["n"].to_numpy()
    upper = boundaries(lengths, counts, lengths * counts, buckets) or [0]
    tops = F.array(*[F.lit(u).cast("long") for u in upper])
    bucket = F.size(F.filter(tops, lambda u: u < F.col("n_tokens")))
    placed = sized.withColumn("bucket", bucket).withColumn("padded_length", F.element_at(tops, F.col("bucket") + 1))
    order = [F.asc_nulls_first("doc_id"), F.col("_hash"), F.col("n_tokens")]
    placed = ranked(placed.withColumn("_all", F.lit(0)), "bucket", "_all", F.pmod(F.xxhash64("doc_id", "_hash"), F.lit(1 << 31)), order)
    each = F.greatest(F.floor(F.lit(token_budget) / F.greatest("padded_length", F.lit(1))), F.lit(1))
    return placed.withColumns(
        {
            "batch": F.floor((F.col("rank") - 1) / each).cast("long"),
            "slot": ((F.col("rank") - 1) % each).cast("long"),
            "padding": F.col("padded_length") - F.col("n_tokens"),
        }
    )


OWN = ["n_tokens", "bucket", "padded_length", "batch", "slot", "padding"]


def pack(docs: DataFrame, buckets: int = 16, token_budget: int = 65536, length: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_length, batch, slot, padding: a row for each row of `docs`.

    Batches are numbered from 0 inside their bucket; every batch but a bucket's last holds
    token_budget // padded_length documents (one at least). Places inside a bucket come from
    counts of hash cells, so that a bucket with most of the rows is no single task.
    """
    rows = pick(docs, "doc_id", "text") if length is None else docs
    size = word_count(F.col("text")) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    sized = written(rows.select("doc_id", F.xxhash64("text").alias("_hash"), size.alias("n_tokens")), "lengths")
    return _placed(sized, buckets, token_budget).select("doc_id", *OWN)


def packed(docs: DataFrame, buckets: int = 16, token_budget: int = 65536) -> DataFrame:
    """`pack` with the documents themselves: doc_id, text, source, copy, and what `pack` returns.

    Of rows equal in id and text, `copy` counts from 1 by their places. The rows are written with a
    number of their own, by which each meets its place: texts are shuffled once.
    """
    rows = pick(docs, "doc_id", "text", "source").withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows.withColumns({"_hash": F.xxhash64("text"), "n_tokens": word_count(F.col("text"))}), "documents")
    placed = _placed(rows.select("_row", "doc_id", "_hash", "n_tokens"), buckets, token_budget)
    copies = W.partitionBy("doc_id", "_hash").orderBy("bucket", "batch", "slot")
    placed = placed.withColumn("copy", F.row_number().over(copies)).select("_row", "copy", *OWN)
    return rows.drop("_hash", "n_tokens").join(placed, "_row").select("doc_id", "text", "source", "copy", *OWN)
