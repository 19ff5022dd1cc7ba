from __future__ import annotations

import hashlib
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from sparrowline.llm.centroid_clusters import assign, cluster, lower_bounds, segment_norms

KIND = "vec_id long, embedding array<double>, cluster int, X string"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], KIND)


def brute(rows, k, rounds, dim):
    """Plain clustering in Python's integers."""
    kept = [(i, [floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    by = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in by[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for c, some in groups.items():
            centroids[c] = [floor(Fraction(sum(x), len(some))) for x in zip(*some)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, sum(e for _, e, f in found if f == c), total, digest[c]) for i, d, c in found], key=repr)


@pytest.mark.parametrize("dim", [8, 11])
def test_clusters_are_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    middles = rng.normal(size=(6, dim))
    rows = [(i, (middles[i % 6] + 0.2 * rng.normal(size=dim)).tolist()) for i in range(300)]
    same = middles[0].tolist()
    rows += [(1000 + i, same) for i in range(150)]  # one very common vector
    rows += [(3, same), (3, same), (None, same), (2001, None), (2002, []), (2003, [1.0] * (dim + 1)), (2004, [float("nan")] + [0.0] * (dim - 1)), (2005, [None] * dim), (2006, [0.0] * dim), (2007, [float("-inf")] * dim)]
    found = cluster(frame(spark, rows), k=10, dim=dim)
    assert found.columns == COLUMNS
    assert sorted([tuple(r) for r in found.collect()], key=repr) == brute(rows, 10, 5, dim)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(5, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [-3.0, 0.5])]
    assert sorted(map(tuple, cluster(frame(spark, rows), dim=2).collect())) == brute(rows, 40, 5, 2)
    assert cluster(frame(spark, []), dim=2).collect() == []
    assert cluster(frame(spark, [(1, None)]), dim=2).columns == COLUMNS


def test_large_components_stay_exact(spark):
    rows = [(1, [3.0e12, 1.0]), (2, [3.0e12 + 0.00390625, 1.0]), (3, [-1.0, 0.25]), (4, [3.0e12, 1.00390625])]
    small = [(i, [v / 1.0e6 for v in x]) for i, x in rows]
    assert sorted(map(tuple, cluster(frame(spark, small), k=2, dim=2).collect())) == brute(small, 2, 5, 2)
    with pytest.raises(Exception, match="53 bits|64-bit"):
        cluster(frame(spark, rows + [(5, [1.0e300, 0.0])]), k=2, dim=2).collect()


def test_screening_leaves_out_only_what_is_farther():
    rng = np.random.default_rng(4)
    middles = np.floor(256 * rng.normal(size=(40, 64)))
    x = middles[rng.integers(0, 40, 2000)] + np.floor(20 * rng.normal(size=(2000, 64)))
    exact = ((x[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (lower_bounds(segment_norms(x), segment_norms(middles)) <= exact).all()
    found, best, measured = assign(x, segment_norms(x), middles)
    assert (found == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert measured < 0.25 * exact.size  # most centroids are never measured
