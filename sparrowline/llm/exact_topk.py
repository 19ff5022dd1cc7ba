"""Exact top-k search: tiled matrix products of queries and shards, merged as a tree.

Each component x of a vector becomes floor(scale * x), x as double; the score is the integer
inner product. All rows are dealt into shards and the queries into blocks, each of `tile_rows`
vectors at most, about, whatever the size of the table. A tile is a block meeting a shard: matrix
products over runs of the shard's rows, in doubles where all sums stay exact and in integers
otherwise, each followed by a partial selection that keeps every query's k best. The lists of
each query are merged over groups of shards, level by level.

A row travels once for each block and a query once for each shard. As shards and blocks are as
large as a task's memory allows, that is far less than the tiles' number suggests: 10^8 vectors of 64 numbers
make 1,526 shards and 77 blocks of queries.

Defined cases: see vectors; equal scores go to the smaller vec_id; a query is never its own
candidate; with fewer than k candidates all are returned; no queries or an empty table give an
empty result; a score among the k best that no 64-bit integer holds is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowline.llm.vectors import TopLists, by_dimension, steps, matrix, merged, ranks, tile_rows

QUERIES_AT_ONCE, ROWS_AT_ONCE = 512, 4096
LISTS = "query_id long, shard int, top array<struct<neg_score:long,vec_id:long>>"


def integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * vectors)


def one_each(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In ascending order of ids; of several rows with an id the smallest vector counts."""
    order = np.argsort(ids, kind="stable")
    same = ids[order][1:] == ids[order][:-1]
    if same.any():
        order = np.lexsort((*vectors.T[::-1], ids))
        order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]]
    return ids[order], vectors[order]


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> TopLists:
    """Each query's k best rows of the shard; ids are in ascending order, all numbers whole."""
    wide = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    kind = np.float64 if wide < 2**53 else np.int64 if wide < 2**62 else object
    if kind is object:
        return _by_integers(query_ids, queries, ids, vectors, k)
    queries, vectors = queries.astype(kind), vectors.astype(kind)
    out = TopLists(len(query_ids), k, kind)
    own = np.searchsorted(ids, query_ids)
    for a in range(0, len(query_ids), QUERIES_AT_ONCE):
        part = slice(a, a + QUERIES_AT_ONCE)
        best = TopLists(len(query_ids[part]), k, kind)
        for lo, hi in steps(len(ids), 4 * k, ROWS_AT_ONCE):
            scores = vectors[lo:hi] @ queries[part].T
            at = np.flatnonzero((own[part] >= lo) & (own[part] < hi))
            at = at[ids[own[part][at]] == query_ids[part][at]]
            scores[own[part][at] - lo, at] = best.least
            best.add(scores, ids[lo:hi])
        out.scores[part], out.ids[part] = best.scores, best.ids
    return out


def _by_integers(query_ids, queries, ids, vectors, k: int) -> TopLists:
    """The same for numbers of any size, in Python's integers."""
    whole = np.frompyfunc(int, 1, 1)
    vectors, out = whole(vectors), TopLists(len(query_ids), k, np.int64)
    for r, (name, query) in enumerate(zip(query_ids, whole(queries))):
        scores = sorted((-s, i) for s, i in zip((vectors @ query).tolist(), ids.tolist()) if i != name)[:k]
        if any(abs(s) >= 2**63 for s, _ in scores):
            raise OverflowError(f"a score of query {name} is no 64-bit integer")
        out.scores[r, : len(scores)], out.ids[r, : len(scores)] = [-s for s, _ in scores], [i for _, i in scores]
    return out


def search(embeddings: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, most_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row whose vec_id `every` divides."""
    return by_dimension(embeddings, lambda rows, dim: _search(rows, every, k, scale, most_rows or tile_rows(dim)), "long")


def _search(rows: DataFrame, every: int, k: int, scale: float, most: int) -> DataFrame:
    is_query = F.col("vec_id") % every == 0
    n = rows.agg(F.count("*").alias("rows"), F.count_if(is_query).alias("queries")).first()
    blocks = max(1, -(-n.queries // most))
    # As many shards as keep all cores at work, more where they would be too large.
    shards = max(1, -(-n.rows // most), min(2 * rows.sparkSession.sparkContext.defaultParallelism // blocks, n.rows // 1024))

    def dealt(parts: int):
        return F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")

    def every_one(parts: int):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    candidates = rows.select(dealt(shards).alias("shard"), every_one(blocks).alias("block"), "vec_id", "embedding")
    # Both sides of a cogroup need columns of their own.
    queries = rows.filter(is_query).select(every_one(shards).alias("shard"), dealt(blocks).alias("block"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return TopLists(0, k, np.int64).lists(np.zeros(0, np.int64), 0, pa.int64())
        (query_ids, queries), (ids, vectors) = (
            one_each(t[name].to_numpy(), matrix(t[vector])) for t, name, vector in ((right, "query_id", "query"), (left, "vec_id", "embedding"))
        )
        found = tile(query_ids, integers(queries, scale), ids, integers(vectors, scale), k)
        return found.lists(query_ids, key[0].as_py(), pa.int64())

    lists = candidates.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(run, LISTS)
    return ranks(merged(lists, k, shards), -F.col("x.neg_score"))
