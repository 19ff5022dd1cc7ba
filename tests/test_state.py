"""State that is written: versions, buckets, batches played again, writers that die; landing and sightings against plain loops."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparrowline.operators import merge as M
from sparrowline.operators import stateful as S
from sparrowline.sources.snapshots import Conflict, Snapshots
from sparrowline.streaming import runs as ST
from sparrowline.streaming import state as T


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/store")


def numbers(spark, keys, value):
    return spark.createDataFrame([(k, value) for k in keys], "k long, v string")


def replaced(old, new):
    return M.upsert(old, new.withColumn("_at", F.lit(1)), ["k"], "_at")


def test_only_buckets_that_change_are_written(spark, store):
    store.create("t", numbers(spark, range(200), "a"), ["k"], buckets=8)
    before = store.manifest()["tables"]["t"]["files"]
    assert sum(f["rows"] for f in before.values()) == 200 and len(before) == 8
    store.merge("t", numbers(spark, [3], "b"), replaced)
    after = store.manifest()["tables"]["t"]["files"]
    assert sum(before[b] != after[b] for b in before) == 1
    # A change that changes nothing leaves all files where they are.
    store.merge("t", numbers(spark, range(50), "a").filter("k <> 3"), replaced)
    assert store.manifest()["tables"]["t"]["files"] == after
    assert rows_of(store.read("t")) == sorted([(k, "b" if k == 3 else "a") for k in range(200)])
    assert rows_of(store.read("t", version=1)) == [(k, "a") for k in range(200)]
    store.merge("t", numbers(spark, range(200), "x"), lambda old, gone: old.join(gone.select("k"), "k", "left_anti"))
    assert store.read("t").count() == 0 and store.versions() == [1, 2, 3, 4]
    assert store.forget(keep=1) > 0 and store.versions() == [4] and store.read("t").columns == ["k", "v"]


def test_a_writer_that_dies_leaves_the_old_version(spark, store, monkeypatch):
    store.create("t", numbers(spark, range(20), "a"), ["k"], buckets=2)

    def die(manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", die)  # all data is written by then
        with pytest.raises(KeyboardInterrupt):
            store.merge("t", numbers(spark, range(20), "b"), replaced)
    with pytest.raises(Exception):
        store.merge("t", numbers(spark, [1], "b"), lambda old, new: old.select(F.raise_error(F.lit("dies")).alias("k"), "v"))
    assert store.versions() == [1] and rows_of(store.read("t")) == [(k, "a") for k in range(20)]
    assert store.forget(keep=1) == 2  # what the dead writer left


def test_of_two_writers_one_is_refused(spark, store):
    store.create("t", numbers(spark, range(5), "a"), ["k"], buckets=2)
    other = Snapshots(spark, store.path)
    seen = other.manifest()
    store.merge("t", numbers(spark, [1], "b"), replaced)
    with pytest.raises(Conflict):
        other._publish(seen | {"version": seen["version"] + 1})
    assert dict(rows_of(store.read("t")))[1] == "b"


def test_a_batch_goes_in_once(spark, store):
    store.create("t", numbers(spark, [], "a"), ["k"], buckets=2)
    for number in (0, 1, 1, 0):
        store.merge("t", numbers(spark, [number], "a"), lambda old, new: old.unionByName(new), ("stream", number))
    assert rows_of(store.read("t")) == [(0, "a"), (1, "a")] and store.batch("stream") == 1 and store.batch("other") == -1


def landed_plainly(batches, screened):
    urls, digests, out = set(screened), set(), []
    for batch in batches:
        for scope, url, digest, order in sorted(batch, key=lambda r: r[3]):
            if (scope, url) not in urls and (scope, digest) not in digests:
                urls.add((scope, url))
                digests.add((scope, digest))
                out.append((scope, url, digest, order))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_landing_is_one_row_after_the_other(spark, store, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(2), f"u{rng.randrange(12)}", f"h{rng.randrange(9)}", i) for i in range(60)]
    rows += [(5, f"u{i // 2}", f"h{(i + 1) // 2}", 100 + i) for i in range(8)]  # a chain by turns of url and content
    batches = [rows[:30], rows[30:45], rows[45:]]
    kind = "scope long, url string, digest string, place long"
    screened = [(0, "u3"), (1, "u5")]
    known = spark.createDataFrame(screened, "scope long, url string")
    T.create_landing(store, spark.createDataFrame([], kind), "scope", "url", "digest", buckets=4)
    each = T.landing(store, "s", [known], "scope", "url", "digest", "place")
    for number, batch in enumerate(batches):
        each(spark.createDataFrame(batch, kind), number)
        each(spark.createDataFrame(batch, kind), number)  # played again
    assert rows_of(store.read(T.LANDED)) == landed_plainly(batches, screened)
    assert store.read(T.HASHES).count() == store.read(T.LANDED).count()


def sighted_plainly(batches, initial):
    state, last = {k: [m, s, m >= S.MISSES] for k, (m, s) in initial.items()}, {}
    since, pending = {}, {}
    for batch in batches:
        for source, kind, run, url in batch:
            if kind == T.WATCH:
                state.setdefault((source, url), [0, None, False])
                since[source, url] = run
            if kind == T.SEEN:
                pending.setdefault((source, run), set()).add(url)
        for source, kind, run, _ in sorted(batch, key=lambda r: r[2]):
            if kind == T.RUN:
                for (s, url), v in state.items():
                    if s == source and run >= since.get((s, url), run):
                        seen = url in pending.get((source, run), ())
                        v[:] = [0, run, False] if seen else [v[0] + 1, v[1], v[0] + 1 >= S.MISSES]
                        last[s, url] = tuple(v)
    return last


def test_sightings_over_batches_and_a_restart(spark, store, tmp_path):
    rng = random.Random(8)
    urls = [f"u{i}" for i in range(9)]
    batches = []
    for b in range(5):
        batch = [(s, T.WATCH, 10 * b + 5, f"late{b}") for s in range(3)] if b in (1, 3) else []
        for run in range(10 * b, 10 * b + 10):
            for s in range(3):
                batch += [(s, T.SEEN, run, u) for u in [*urls, "late1", "late3"] if rng.random() < 0.3]
                batch += [(s, T.RUN, run, None)] if rng.random() < 0.7 else []
        batches.append(batch)
    held = [r for r in batches[1] if r[1] == T.SEEN and r[2] == 19 and (r[0], T.RUN, 19, None) in batches[1]]
    moved = [r for r in batches[1] if r[1] == T.RUN and r[2] == 19]  # runs whose sightings came a batch before
    batches[1] = [r for r in batches[1] if r not in moved]
    batches[2] = moved + batches[2]
    assert held and moved
    initial = {(s, u): (i % 5, None) for s in range(3) for i, u in enumerate(urls)}
    first = spark.createDataFrame([(s, u, m, last) for (s, u), (m, last) in initial.items()], "source long, url string, missed_runs int, last_seen_run long")
    schema = "source long, kind string, run_id long, url string"
    store.create("sightings", spark.createDataFrame([], T.SIGHTINGS), ["source", "url"], buckets=3)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.STATE_STORE)
    try:
        folder = tmp_path / "in"
        for i, batch in enumerate(batches):  # the stream ends after each batch and is started again from its checkpoint
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
            stream = T.sightings(ST.read_folder(spark, str(folder), spark.createDataFrame([], schema).schema), shards=3, initial=first)
            keep = T.keep_latest(store, "sightings", "runs", ["source", "url"])
            stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = {(r.source, r.url): (r.missed_runs, r.last_seen_run, r.closed) for r in store.read("sightings").collect()}
    assert found == sighted_plainly(batches, initial)
    assert len(Counter(v[2] for v in found.values())) == 2  # some are closed, some open
