"""What the two vector searches share: which vectors take part, tiles, partial selection, merging of top lists.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows
without id. Vectors of different dimensions have no inner product: each dimension is searched
by itself. Of rows with the same id and dimension, the one with the smallest vector counts.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowline.llm.common import pick, written

#: Bytes of vectors, as doubles, that one side of a tile holds.
TILE_BYTES = 32 << 20
RESULT = "query_id long, rank int, vec_id long, score"


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding (of floats as they are, else of doubles) of the vectors that take part, written once."""
    rows = pick(embeddings, "vec_id", "embedding")
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return written(rows.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad), "vectors")


def by_dimension(embeddings: DataFrame, search: Callable[[DataFrame, int], DataFrame], score: str) -> DataFrame:
    """What `search(rows, dimension)` finds for the vectors of each dimension; tables have one, as a rule."""
    rows = usable(embeddings)
    dims = sorted(r[0] for r in rows.select(F.size("embedding")).distinct().collect())
    if not dims:
        return embeddings.sparkSession.createDataFrame([], f"{RESULT} {score}")
    return functools.reduce(DataFrame.unionByName, [search(rows.filter(F.size("embedding") == d), d) for d in dims])


def first_of_id(rows: DataFrame) -> DataFrame:
    """One row an id. Only ids are shuffled where none is repeated."""
    again = written(rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id"), "repeated")
    least = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return rows.join(again, "vec_id", "left_anti").select("vec_id", "embedding").unionByName(least)


def tile_rows(dim: int) -> int:
    return max(256, TILE_BYTES // (8 * dim))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as rows of a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def best_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its k largest scores, largest first, ties to the smaller place.

    Partial selection finds the k-th score; only columns at or above it are sorted.
    """
    if scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    limit = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    above, ties = scores > limit, scores == limit
    ties &= np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True)
    chosen = np.nonzero(above | ties)[1].reshape(len(scores), k)
    order = np.argsort(-np.take_along_axis(scores, chosen, axis=1), axis=1, kind="stable")
    return np.take_along_axis(chosen, order, axis=1)


class TopLists:
    """The k best of what each of some queries has met so far, in arrays; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, kind):
        self.k = k
        self.least = np.iinfo(kind).min if np.issubdtype(kind, np.integer) else -np.inf
        self.scores = np.full((queries, k), self.least, dtype=kind)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores[id, query]; ids come in ascending order over all calls."""
        # An equal score of a later, so larger, id changes nothing: only what is above a query's k-th counts.
        at, row = np.nonzero(scores > self.scores[:, -1])
        if not len(row):
            return
        some = np.unique(row)
        held = np.repeat(some, self.k)
        row = np.concatenate([held, row])
        new = np.concatenate([self.scores[some].ravel(), scores[at, row[len(held) :]]])
        named = np.concatenate([self.ids[some].ravel(), ids[at]])
        # Held entries come first and the others by id, so a stable sort keeps ties in the order of ids.
        order = np.argsort(-new, kind="stable")
        order = order[np.argsort(row[order].astype(np.int16 if len(self.ids) < 1 << 15 else np.int64), kind="stable")]
        first = np.searchsorted(row[order], some)
        take = order[first[:, None] + np.arange(self.k)]
        self.scores[some], self.ids[some] = new[take], named[take]

    def lists(self, query_ids: np.ndarray, shard: int, kind: pa.DataType) -> pa.Table:
        """query_id, shard, top: the lists of queries that met anything."""
        there = self.scores > self.least
        sizes = there.sum(axis=1)
        some = sizes > 0
        scores = pa.array((-self.scores[there]).astype(kind.to_pandas_dtype()), kind)
        entries = pa.StructArray.from_arrays([scores, pa.array(self.ids[there])], names=["neg_score", "vec_id"])
        offsets = np.r_[0, np.cumsum(sizes[some])].astype(np.int32)
        return pa.table(
            [pa.array(query_ids[some]), pa.array(np.full(int(some.sum()), shard, dtype=np.int32)), pa.ListArray.from_arrays(offsets, entries)],
            names=["query_id", "shard", "top"],
        )


def steps(n: int, first: int, most: int) -> list[tuple[int, int]]:
    """Runs of candidates, each as long as all before it, from `first` to `most`: each then adds few to the top lists."""
    out, lo = [], 0
    while lo < n:
        hi = min(n, lo + min(most, max(first, lo)))
        out.append((lo, hi))
        lo = hi
    return out


def merged(lists: DataFrame, k: int, shards: int, fan_in: int = 16) -> DataFrame:
    """query_id, top: lists (query_id, shard, top) merged as a tree, `fan_in` shards at a time.

    `top` is an array of (neg_score, vec_id), so its ascending order is that of the ranks.
    """
    while True:
        shards = -(-shards // fan_in)
        lists = (
            lists.groupBy("query_id", F.floor(F.col("shard") / fan_in).cast("int").alias("shard"))
            .agg(F.flatten(F.collect_list("top")).alias("top"))
            .withColumn("top", F.slice(F.array_sort("top"), 1, k))
        )
        if shards <= 1:
            return lists.select("query_id", "top")


def ranks(tops: DataFrame, score: Column) -> DataFrame:
    """query_id, rank, vec_id, score, one row for each entry of `top`."""
    rows = tops.select("query_id", F.posexplode("top").alias("place", "x"))
    return rows.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), score.alias("score"))
