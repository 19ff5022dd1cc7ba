"""Centroid clustering of whole-number vectors, screened by the norms of segments.

Each component x becomes floor(scale * x), x as double. A vector is cut into `SEGMENTS` segments of
neighbouring components, and the squared norm of each segment is kept beside it, once: that is its
compressed form. By Cauchy and Schwarz the product of two segments is at most the product of their
norms, so

    |v - c|^2  >=  |v|^2 + |c|^2 - 2 * sum over segments of |v_s| * |c_s|

needs one short matrix product for all vectors and centroids of a batch. The centroid with the least
bound is measured exactly first; then only centroids whose bound does not exceed the best distance
so far are measured, in exact integers. Bounds are lowered by more than their rounding error, so
none that is nearest, or equally near, is ever screened out.

A round is one pass over the written vectors: each task gives a row a cluster that it has met (count
and componentwise sums), Spark adds them up, and the driver holds `k` centroids and nothing else.
Vectors never move, so it does not matter how many of them are equal or fall into one cluster.

Defined cases. Vectors with another number of components than `dim`, or with null or non-finite
ones, and null vectors take no part. Repeated ids are vectors of their own, and so are rows without
id; where they compete to be a first centroid, the smaller vector comes first, and rows without id
come after all others. With fewer than `k` vectors each one starts a centroid; an empty table gives
an empty result. A centroid that loses its vectors stays where it is. Equal distances go to the
smaller number. A whole component of more than 53 bits is an error, and so is a distance or a sum
that no 64-bit integer holds. Extra columns are left out, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowline.llm.common import pick, written
from sparrowline.llm.vectors import matrix

SEGMENTS = 8
KEPT = "vec_id long, x array<double>, norms array<double>"
PARTIAL = "cluster int, n long, sums array<long>"
#: Whole numbers in doubles are exact below this.
EXACT = 2.0**53
MOST = 2**63 - 1


def segment_norms(x: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Squared norms of each row's segments; the last segments are shorter where the columns do not divide evenly."""
    width = -(-x.shape[1] // segments)
    starts = np.arange(0, x.shape[1], width)
    return np.add.reduceat(x * x, starts, axis=1)


def lower_bounds(norms: np.ndarray, centroid_norms: np.ndarray) -> np.ndarray:
    """bounds[vector, centroid], never above the exact squared distance."""
    total = norms.sum(axis=1)[:, None] + centroid_norms.sum(axis=1)[None, :]
    bounds = total - 2 * (np.sqrt(norms) @ np.sqrt(centroid_norms).T)
    # Each term is rounded to 2^-53 of the total at most, and there are far fewer than 2^10 of them.
    return bounds - total * 2.0**-40


def _exact_kind(x: np.ndarray, centroids: np.ndarray):
    """Doubles where all squared distances are whole numbers below 2^53, else Python's integers."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    return np.float64 if 4 * x.shape[1] * most**2 < EXACT else object


def _distances(x: np.ndarray, c: np.ndarray, kind) -> np.ndarray:
    """Exact squared distances of rows to one centroid."""
    if kind is object:
        whole = np.frompyfunc(int, 1, 1)
        apart = whole(x) - whole(c)
        return (apart * apart).sum(axis=1)
    apart = x - c
    return np.einsum("ij,ij->i", apart, apart)


def assign(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid, its exact squared distance, and how many exact distances that took."""
    kind = _exact_kind(x, centroids)
    bounds = lower_bounds(norms, segment_norms(centroids))
    first = bounds.argmin(axis=1)
    nearest, best, measured = first.copy(), np.zeros(len(x), dtype=kind), len(x)
    for c in np.unique(first):
        at = np.flatnonzero(first == c)
        best[at] = _distances(x[at], centroids[c], kind)
    for c in range(len(centroids)):
        at = np.flatnonzero((bounds[:, c] <= best.astype(np.float64)) & (first != c))
        if len(at):
            measured += len(at)
            d = _distances(x[at], centroids[c], kind)
            closer = (d < best[at]) | ((d == best[at]) & (c < nearest[at]))
            nearest[at[closer]], best[at[closer]] = c, d[closer]
    return nearest, best, measured


def _kept(embeddings: DataFrame, dim: int, scale: float) -> DataFrame:
    """vec_id, whole components and squared segment norms of the vectors that take part, written once."""
    rows = pick(embeddings, "vec_id", "embedding")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter((F.size("embedding") == dim) & ~bad)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.floor(scale * matrix(batch["embedding"]))
            if np.abs(x).max() >= EXACT:
                raise OverflowError("a whole component has more than 53 bits")
            yield pa.record_batch([batch["vec_id"], _lists(x), _lists(segment_norms(x))], names=["vec_id", "x", "norms"])

    return written(rows.mapInArrow(compress, KEPT), "whole_vectors")


def _lists(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))


def _first(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors with the k smallest hashes of seed and id: a top-k report, so k rows reach the driver."""
    by = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    return np.array([r.x for r in rows.orderBy(F.asc_nulls_last(by), "x").limit(k).select("x").collect()])


def _sums(rows: DataFrame, centroids: np.ndarray, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of each cluster's vectors: a row a cluster."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), dim), dtype=object)
        for batch in batches:
            x = matrix(batch["x"])
            if not len(x):
                continue
            cluster, _, _ = assign(x, matrix(batch["norms"]), centroids)
            for c in np.unique(cluster):
                some = x[cluster == c]
                counts[c] += len(some)
                exact = len(some) * np.abs(some).max() < EXACT
                sums[c] += [int(s) for s in some.sum(axis=0)] if exact else [sum(map(int, column)) for column in some.T]
        met = np.flatnonzero(counts)
        columns = pa.array(met, pa.int32()), pa.array(counts[met]), pa.array([list(s) for s in sums[met]], pa.list_(pa.int64()))
        yield pa.record_batch(list(columns), names=["cluster", "n", "sums"])

    by_cluster = rows.mapInArrow(partial, PARTIAL).groupBy("cluster")
    found = by_cluster.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums")).collect()
    return {r.cluster: (r.n, r.sums) for r in found}


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each vector that takes part."""
    spark = embeddings.sparkSession
    rows = _kept(embeddings, dim, scale)
    centroids = _first(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        for c, (n, sums) in _sums(rows, centroids, dim).items():
            centroids[c] = [s // n for s in sums]
    last = centroids

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["x"])
            if not len(x):
                continue
            found, best, _ = assign(x, matrix(batch["norms"]), last)
            if best.dtype == object and max(best) > MOST:
                raise OverflowError("a squared distance is no 64-bit integer")
            distance = pa.array(best.astype(np.int64))
            yield pa.record_batch([batch["vec_id"], pa.array(found.astype(np.int32)), distance], names=["vec_id", "cluster", "distance"])

    assigned = written(rows.mapInArrow(measure, "vec_id long, cluster int, distance long"), "assigned")
    # A row a cluster, k at most.
    inertias = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in last]
    facts = spark.createDataFrame([(c, inertia, digests[c]) for c, inertia in sorted(inertias.items())], "cluster int, cluster_inertia long, centroid_sha256 string")
    total = F.lit(sum(inertias.values())).cast("long")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")
