"""Landing and sightings as streams over state that is really kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparrowline.operators.merge import upsert
from sparrowline.operators.stateful import MISSES, land
from sparrowline.sources.snapshots import Snapshots

LANDED, HASHES = "landed", "hashes"


def create_landing(store: Snapshots, empty: DataFrame, scope: str, url: str, digest: str, buckets: int = 16) -> None:
    """Two tables: rows by scope and url, and which content has landed by scope and hash."""
    store.create(LANDED, empty, [scope, url], buckets)
    store.create(HASHES, empty.select(scope, digest), [scope, digest], buckets)


def landing(store: Snapshots, stream: str, known: Sequence[DataFrame], scope: str, url: str, digest: str, order: str) -> Callable[[DataFrame, int], None]:
    """What `foreachBatch` calls: lands a batch's new rows and their hashes in one version.

    A row is known by its url from the landed rows or one of the `known` lists, then by its content; within the batch as well,
    in the given order. A batch that has gone in before, because the stream was started again, adds nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        if number <= store.batch(stream):
            return
        batch = batch.persist()
        try:
            landed, hashes = store.manifest()["tables"][LANDED], store.manifest()["tables"][HASHES]
            # Only buckets that the batch falls into are read.
            some = [[r[0] for r in batch.select(store._bucket(t)).distinct().collect()] for t in (landed, hashes)]
            fresh = land(batch, [store.read(LANDED, buckets=some[0]), *known], store.read(HASHES, buckets=some[1]), scope, url, digest, order)

            def added(old: DataFrame, new: DataFrame) -> DataFrame:
                return old.unionByName(new.select(*old.columns))

            store.merge_all({LANDED: (fresh, added), HASHES: (fresh, added)}, (stream, number))
        finally:
            batch.unpersist()

    return run


WATCH, SEEN, RUN = "watch", "seen", "run"
SIGHTINGS = "source long, url string, missed_runs int, last_seen_run long, closed boolean"


class SightingProcessor(StatefulProcessor):
    """For a part of a source's postings: trusted runs in a row that have not shown each.

    Rows come as (kind, run_id, url): `watch` a posting from a run on, a posting `seen` in a run, and the
    trusted `run` itself, which judges what was seen in it. Runs come in the order of their ids; what was seen waits for its run.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.postings = handle.getMapState("postings", "url string", "missed int, last long, since long")
        self.waiting = handle.getListState("waiting", "run_id long, url string")

    def handleInitialState(self, key, initial: pd.DataFrame, timerValues) -> None:
        for r in initial.itertuples():
            last = None if pd.isna(r.last_seen_run) else int(r.last_seen_run)
            self.postings.updateValue((r.url,), (int(r.missed_runs), last, None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [r for r in rows if len(r)]
        if not frames:
            return
        given = pd.concat(frames)
        held = {k[0]: tuple(v) for k, v in self.postings.iterator()} if self.postings.exists() else {}
        before, changed = dict(held), set()
        for r in given[given.kind == WATCH].itertuples():
            held.setdefault(r.url, (0, None, None if pd.isna(r.run_id) else int(r.run_id)))
        waiting: dict[int, set[str]] = {}
        for run, url in self.waiting.get() if self.waiting.exists() else ():
            waiting.setdefault(run, set()).add(url)
        for r in given[given.kind == SEEN].itertuples():
            waiting.setdefault(int(r.run_id), set()).add(r.url)
        for run in sorted(set(given[given.kind == RUN].run_id.astype(int))):
            shown = waiting.pop(run, set())
            for old in [w for w in waiting if w < run]:  # in no trusted run
                del waiting[old]
            for url, (missed, last, since) in held.items():
                if since is not None and run < since:
                    continue
                held[url] = (0, run, since) if url in shown else (missed + 1, last, since)
                changed.add(url)
        for url in changed | (held.keys() - before.keys()):
            self.postings.updateValue((url,), held[url])
        held_back = [(run, url) for run, urls in waiting.items() for url in urls]
        if held_back:
            self.waiting.put(held_back)
        else:
            self.waiting.clear()
        out = [(int(key[0]), url, held[url][0], held[url][1], held[url][0] >= MISSES) for url in sorted(changed)]
        yield pd.DataFrame(out, columns=["source", "url", "missed_runs", "last_seen_run", "closed"]).astype({"last_seen_run": "Int64"})

    def close(self) -> None:
        pass


def sightings(rows: DataFrame, shards: int = 8, initial: DataFrame | None = None) -> DataFrame:
    """Updates of each posting from a stream of (source, kind, run_id, url): missed runs, last sighting, closed.

    A source's postings are dealt to `shards` by their url, and its runs go to each, so a large source is no single task.
    `initial` has (source, url, missed_runs, last_seen_run) from before the stream.
    """

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64("url"), F.lit(shards)).cast("int"))

    every = F.when(F.col("kind") == RUN, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod(F.xxhash64("url"), F.lit(shards)).cast("int")))
    keyed = rows.select("source", "kind", "run_id", "url", F.explode(every).alias("shard")).groupBy("source", "shard")
    before = {} if initial is None else {"initialState": dealt(initial).groupBy("source", "shard")}
    return keyed.transformWithStateInPandas(SightingProcessor(), SIGHTINGS, outputMode="Update", timeMode="None", **before)


def keep_latest(store: Snapshots, name: str, stream: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """What `foreachBatch` calls to keep a stream's updates as a table: one row a key, the last one."""

    def run(batch: DataFrame, number: int) -> None:
        store.merge(name, batch, lambda old, new: upsert(old, new.withColumn("_at", F.lit(number)), list(keys), "_at"), (stream, number))

    return run
