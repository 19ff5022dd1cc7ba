from __future__ import annotations

import numpy as np
import pytest

from sparrowline.llm import ann, exact_topk
from sparrowline.llm.vectors import TopLists, best_columns, steps

KIND = "vec_id long, embedding array<float>, score int, Embedding string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], KIND)


def brute(rows, value, every, k, zero_ok):
    """Plain search over the rows that take part."""
    fine = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or (not zero_ok and not any(v)):
            continue
        v = tuple(float(np.float32(x)) for x in v)
        fine[i] = min(fine.get(i, v), v)
    fine = {i: value(np.array(v)) for i, v in fine.items()}
    out = []
    for q in (i for i in fine if i % every == 0):
        best = sorted((-(fine[q] * v).sum(), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def odd_rows(rng, n, dim=8):
    rows = [(i, rng.normal(size=dim).tolist()) for i in range(n)]
    same = rng.normal(size=dim).tolist()
    rows += [(i, same) for i in range(n, n + n // 2)]  # one very common vector
    rows += [(None, same), (9001, None), (9002, []), (9003, [1.0] * (dim - 1)), (9004, [float("nan")] * dim), (9005, [None] * dim)]
    return rows + [(9006, [float("inf")] + [0.0] * (dim - 1)), (9020, [0.0] * dim), rows[0], (20, same), (-20, same)]


def test_best_columns_is_a_stable_sort():
    rng = np.random.default_rng(0)
    for k in (1, 3, 10, 40):
        x = rng.integers(0, 6, size=(50, 23)).astype(float)
        assert np.array_equal(best_columns(x, k), np.argsort(-x, axis=1, kind="stable")[:, :k])


@pytest.mark.parametrize("most_rows", [None, 64])
def test_exact_search_is_brute_force(spark, most_rows):
    rows = odd_rows(np.random.default_rng(1), 200)
    found = exact_topk.search(frame(spark, rows), most_rows=most_rows).collect()
    want = brute(rows, lambda v: np.floor(64 * v), 20, 20, zero_ok=True)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == want


def test_top_lists_are_those_of_a_whole_sort():
    rng = np.random.default_rng(4)
    scores, ids = rng.integers(0, 9, size=(20, 300)).astype(float), np.arange(300) * 3
    best = TopLists(20, 7, np.float64)
    for lo, hi in steps(300, 10, 64):
        best.add(scores[:, lo:hi].T, ids[lo:hi])
    order = np.argsort(-scores, axis=1, kind="stable")[:, :7]
    assert np.array_equal(best.ids, ids[order])
    assert np.array_equal(best.scores, np.take_along_axis(scores, order, axis=1))


def test_exact_search_ranks_large_numbers_truly(spark):
    """Doubles cannot tell these scores apart."""
    rows = [(0, [3e7, 1.0]), (20, [3e7, 2.0]), (3, [3e7, 3.0]), (4, [3e7, 2.0])]
    found = exact_topk.search(frame(spark, rows)).collect()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found)
    whole = {i: [64 * int(x) for x in v] for i, v in rows}
    want = []
    for q in (0, 20):
        order = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(order)]
    assert got == want


def test_scores_that_no_long_holds_are_an_error(spark):
    with pytest.raises(Exception, match="no 64-bit integer"):
        exact_topk.search(frame(spark, [(0, [1e18]), (1, [1e18])])).collect()


def test_exact_search_with_few_rows(spark):
    assert exact_topk.search(frame(spark, [])).count() == 0
    assert exact_topk.search(frame(spark, [(0, [1.0])])).count() == 0
    assert exact_topk.search(frame(spark, [(1, [1.0]), (3, [2.0])])).count() == 0


def test_small_tables_are_searched_whole(spark):
    rows = odd_rows(np.random.default_rng(2), 300)
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(frame(spark, rows), shard_rows=64).collect())
    want = brute(rows, lambda v: v, 20, 20, zero_ok=False)
    assert [w[:3] for w in found] == [w[:3] for w in want]
    assert np.allclose([w[3] for w in found], [w[3] for w in want], atol=1e-12)
    assert ann.search(frame(spark, [])).count() == 0
    assert ann.search(frame(spark, [(0, [1.0])])).count() == 0


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_is_over_nine_tenths(spark, monkeypatch, clustered):
    rng = np.random.default_rng(3)
    n, dim = 6000, 32
    x = rng.normal(size=(n, dim))
    if clustered:
        x = 0.3 * x + rng.normal(size=(40, dim))[rng.integers(0, 40, n)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(ann, "SAMPLE_LEAST", 2000)
    found = ann.search(frame(spark, rows), shard_rows=1000).collect()
    want = {(q, i) for q, _, i, _ in brute(rows, lambda v: v, 20, 20, zero_ok=False)}
    assert len(found) == len(want)
    assert len({(r.query_id, r.vec_id) for r in found} & want) >= 0.9 * len(want)
    x = x.astype(np.float32).astype(float)
    assert all(abs(r.score - (x[r.query_id] * x[r.vec_id]).sum()) < 1e-12 for r in found)


def far_groups(rng, n):
    """30 groups of 8 vectors far from all others, their ids divided by 20 among them, and n vectors in 40 clusters."""
    x = 0.1 * rng.normal(size=(n, 32)) + rng.normal(size=(40, 32))[rng.integers(0, 40, n)]
    far = np.repeat(30 * rng.normal(size=(30, 32)), 8, axis=0) + 0.1 * rng.normal(size=(240, 32))
    return [(20 * i, v.tolist()) for i, v in enumerate(far)] + [(20 * i + 1, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("n", [1500, 2500])
def test_lists_are_skipped_at_any_size_and_no_query_lacks_rows(spark, monkeypatch, n):
    fit, made = ann.fit, []

    def one_list(*args, **kwargs):
        made.append(fit(*args, **kwargs))
        made[0].probes = 1
        return made[0]

    monkeypatch.setattr(ann, "fit", one_list)
    rows = far_groups(np.random.default_rng(5), n)
    found = ann.search(frame(spark, rows), shard_rows=1000).collect()
    assert made[0].probes == 1 < len(made[0].centres)
    assert len(found) == 240 * 20


def test_a_query_probes_until_there_are_candidates():
    index = ann.Index(np.eye(4), [0, 4], [], 1)
    q = np.array([[4.0, 3.0, 2.0, 1.0], [1.0, 2.0, 3.0, 4.0]])
    sizes = np.array([5, 10, 10, 30])
    assert index.probed(q, sizes, 21).tolist() == [[True, True, True, False], [False, False, False, True]]


@pytest.mark.parametrize("kind", ["queries", "components"])
def test_recall_holds_for_odd_rows(spark, monkeypatch, kind):
    """Queries unlike all other vectors; components of very unequal size, which codes blur."""
    rng = np.random.default_rng(7)
    n, dim = 8000, 32
    if kind == "queries":
        x = 0.3 * rng.normal(size=(n, dim)) + rng.normal(size=(50, dim))[rng.integers(0, 50, n)]
        x[::20] = rng.normal(size=(n // 20, dim))
    else:
        x = rng.standard_t(1.5, size=(n, dim))
    x = x.astype(np.float32).astype(float)
    monkeypatch.setattr(ann, "SAMPLE_LEAST", 2000)
    found = ann.search(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), shard_rows=1000).collect()
    scores = x[::20] @ x.T
    scores[np.arange(n // 20), np.arange(0, n, 20)] = -np.inf
    want = {(20 * q, i) for q, row in enumerate(np.argsort(-scores, axis=1)[:, :20]) for i in row.tolist()}
    assert len(found) == len(want)
    assert len({(r.query_id, r.vec_id) for r in found} & want) >= 0.93 * len(want)
