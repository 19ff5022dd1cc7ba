from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import pytest

from sparrowline.llm.common import word_count
from sparrowline.llm.mixing import mix, mixed
from sparrowline.llm.packing import boundaries, pack, packed


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, s, 1, "x", 2.0) for i, t, s in rows], "doc_id long, text string, source string, size int, TEXT string, rank double"
    )


def words(rng, n):
    return rng.choice([" ", "\n\t", "\x0b"]).join("w" for _ in range(n)) + rng.choice(["", " "])


def odd_rows(rng):
    rows = [(i, words(rng, rng.randint(1, 60)), rng.choice(["a", "b", "Z", "é", None])) for i in range(400)]
    rows += [(1000 + i, words(rng, 20), "hot") for i in range(300)]  # one source and one size
    rows += [(3007, None, "a"), (3008, "", "b"), (None, "one two", "a"), (3005, "same row", "b"), (3005, "same row", "b"), (2000, "x " * 5000, "big"), (2001, "", "empty")]
    return rows


def targets(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").replace("\x0b", " ").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(size.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if most * size[s] <= level * w[s]]
        if not over:
            return out | {s: level * w[s] for s in open_}, size
        for s in over:
            out[s] = most * size[s]
            left -= out[s]
            open_.remove(s)
    return out, size


def test_targets_and_taken_words(spark):
    rows = odd_rows(random.Random(1))
    df = frame(spark, rows)
    found = mix(df).collect()
    want, size = targets(rows)
    assert len(found) == len(rows)
    source = defaultdict(set)
    for i, _, s in rows:
        source[i].add(s)
    taken, largest = Counter(), Counter()
    for r in found:
        s = next(iter(source[r.doc_id] if r.doc_id is not None else {"a"}))
        if r.size and (r.doc_id, s) != (None, None):
            assert abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == size[s]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in want:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1
    again = sorted((r.doc_id or -1, r.size, r.copies) for r in mix(df.repartition(5)).collect())
    assert again == sorted((r.doc_id or -1, r.size, r.copies) for r in found)


def test_mixed_rows_are_the_copies(spark):
    df = frame(spark, odd_rows(random.Random(2)))
    copies = Counter()
    for r in mix(df).collect():
        copies[r.doc_id, r.size] += r.copies
    out = mixed(df)
    assert out.columns == df.columns
    assert Counter((r[0], len((r[1] or "").replace("\x0b", " ").split())) for r in out.collect()) == +copies
    assert mix(df.limit(0)).count() == 0 and mixed(df.limit(0)).count() == 0


def padding(upper, count, total, ends):
    lo = pad = 0
    for e in ends:
        pad += sum(count[lo : e + 1]) * upper[e] - sum(total[lo : e + 1])
        lo = e + 1
    return pad


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_are_the_best_of_all(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 11)
    upper = sorted(rng.sample(range(200), n))
    count = [rng.randint(1, 30) for _ in range(n)]
    total = [c * u - rng.randint(0, min(c, u)) for c, u in zip(count, upper)]
    for k in range(1, 5):
        found = boundaries(upper, count, total, k)
        best = min(
            padding(upper, count, total, [*ends, n - 1])
            for m in range(min(k, n))
            for ends in itertools.combinations(range(n - 1), m)
        )
        assert padding(upper, count, total, [upper.index(u) for u in found]) == best and len(found) <= k
    assert boundaries([], [], [], 4) == []


def test_boundaries_are_exact_for_many_and_large_lengths():
    rng = random.Random(11)
    upper = sorted(rng.sample(range(60_000), 700))
    count = [rng.choice([1, 1, 2, 5, 1000]) for _ in upper]
    total = [c * u for c, u in zip(count, upper)]
    n, pad = len(upper), {}
    for j in range(1, n + 1):
        c = t = 0
        for i in range(j - 1, -1, -1):
            c, t = c + count[i], t + total[i]
            pad[i, j] = c * upper[j - 1] - t
    best = [0] + [pad[0, j] for j in range(1, n + 1)]
    for k in range(2, 8):
        best = [0] + [min(best[i] + pad[i, j] for i in range(j)) for j in range(1, n + 1)]
        found = boundaries(upper, count, total, k)
        assert len(found) == k and padding(upper, count, total, [upper.index(u) for u in found]) == best[n]


def test_documents_are_packed_with_what_they_are(spark):
    rows = [(i, "w " * n, "s") for i, n in enumerate([5000, 5001, 5003, 9000, 3, 3])] + [(2, "w " * 5003, "s")] * 2
    found = packed(frame(spark, rows), buckets=3, token_budget=100).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in found) == Counter(rows)
    assert sorted(r.copy for r in found if r.doc_id == 2) == [1, 2, 3]
    assert {r.padded_length for r in found} == {3, 5003, 9000}


def test_batches_fill_their_budget(spark):
    rng = random.Random(3)
    rows = odd_rows(rng)
    df = frame(spark, rows)
    found = pack(df, buckets=6, token_budget=500).collect()
    assert len(found) == len(rows)
    lengths = Counter((i, len((t or "").replace("\x0b", " ").split())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in found) == lengths
    uppers = {}
    batches = defaultdict(list)
    for r in found:
        assert uppers.setdefault(r.bucket, r.padded_length) == r.padded_length
        assert r.padding == r.padded_length - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r.slot)
    cells = sorted(Counter(n for _, n in lengths.elements()).items())
    best = boundaries([n for n, _ in cells], [c for _, c in cells], [n * c for n, c in cells], 6)
    assert sorted(uppers.values()) == best
    for (bucket, batch), slots in batches.items():
        each = max(1, 500 // max(1, uppers[bucket]))
        last = batch == max(b for k, b in batches if k == bucket)
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == each or last and len(slots) < each)
    assert pack(df.limit(0)).count() == 0


def test_word_count_parts_at_ascii_space_only(spark):
    texts = [None, "", " ", "a\x85b c d", "\x0b\x0ca\r\nb\t", "é 漢"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.n for r in df.select(word_count(df.text).alias("n")).collect()] == [0, 0, 0, 1 + 1 + 1, 2, 2]


def test_rows_without_id_spread_over_cells(spark):
    """100,000 different texts of equal size without id, and as many with one id: no cell holds three times its share."""
    from pyspark.sql import functions as F

    from sparrowline.llm.mixing import tie

    texts = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("s").alias("source"))
    for rows in (texts, texts.withColumn("doc_id", F.lit(7).cast("long"))):
        cells = -(-100_000 // 4096)
        largest = rows.groupBy((tie("doc_id", "text") % cells).alias("cell")).count().agg(F.max("count")).first()[0]
        assert largest < 3 * 4096
    few = texts.limit(20_000)
    found = mix(few)
    assert found.count() == 20_000 and sorted(map(tuple, found.collect())) == sorted(map(tuple, mix(few.repartition(7)).collect()))
