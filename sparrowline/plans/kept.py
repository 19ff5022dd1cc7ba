"""Named queries over state that is written: landing by two keys, sightings as a stream, merges read back from their versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowline.operators import merge as M
from sparrowline.plans.registry import query
from sparrowline.plans.states import MISSED_SQL
from sparrowline.sources.scratch import new_folder
from sparrowline.sources.snapshots import Snapshots
from sparrowline.sources.tables import table
from sparrowline.streaming import state as T
from sparrowline.streaming.runs import STATE_STORE, read_folder


def in_batches(spark: SparkSession, rows: DataFrame, order: str, batches: int) -> DataFrame:
    """A stream that gives rows in so many batches, by ranges of their order."""
    folder = new_folder(spark, "stream")
    ends = F.floor(F.col(order) * batches / (rows.agg(F.max(order)).first()[0] + 1))
    for i in range(batches):
        # A file a batch: the source takes files by the time they were written.
        rows.filter(ends == i).coalesce(1).write.parquet(f"{folder}/{i}")
    return read_folder(spark, f"{folder}/*", rows.schema)


def drained(stream, checkpoint: str, each) -> None:
    """Runs a stream until nothing is left, a file a batch; started again, it goes on where it ended."""
    stream.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@query(
    "landing_two_keys",
    """WITH e AS (SELECT user_id AS source, event_id, 'u' || (event_id % 401) AS url, 'h' || ((event_id % 401) // 3) AS digest FROM events),
         k AS (SELECT * FROM e WHERE NOT (event_id % 401) IN (5, 7) AND NOT (source % 3 = 0 AND (event_id % 401) % 10 = 0))
       SELECT source, url, digest, event_id FROM (SELECT *, row_number() OVER (PARTITION BY source, digest ORDER BY event_id) AS r FROM k) WHERE r = 1""",
)
def landing_two_keys(spark, sf_dir):
    """All events as a stream of pages found, landed by url (three lists) and then by content, in four batches, the last of them played twice."""
    at = F.col("event_id") % 401
    digest = F.concat(F.lit("h"), F.floor(at / 3).cast("long"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), "event_id", F.concat(F.lit("u"), at).alias("url"), digest.alias("digest"))
    sources = events.select("source").distinct()
    screened = sources.withColumn("url", F.explode(F.array(F.lit("u5"), F.lit("u7"))))
    elsewhere = sources.filter("source % 3 = 0").withColumn("url", F.explode(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.concat(F.lit("u"), i * 10))))
    store = Snapshots(spark, new_folder(spark, "landing"))
    T.create_landing(store, events.limit(0), "source", "url", "digest", buckets=4)
    each = T.landing(store, "pages", [screened, elsewhere], "source", "url", "digest", "event_id")
    last = []

    def kept(batch: DataFrame, number: int) -> None:
        each(batch, number)
        last[:] = [number]
        each(batch, number)  # as after a restart

    stream = in_batches(spark, events, "event_id", 4)
    drained(stream, new_folder(spark, "checkpoint"), kept)
    return store.read(T.LANDED).select("source", "url", "digest", "event_id")


@query("missed_runs_stream", MISSED_SQL.replace("AS source, u.url,", "AS source, CAST(u.url AS VARCHAR) AS url,"))
def missed_runs_stream(spark, sf_dir):
    """Sightings as keyed state over the whole history in five batches; the updates are kept as a table."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("run_id"), "event_type")
    seen = events.select("source", F.lit(T.SEEN).alias("kind"), "run_id", (F.col("run_id") % 7).cast("string").alias("url"))
    runs = events.filter("event_type <> 'error'").select("source", F.lit(T.RUN).alias("kind"), "run_id", F.lit(None).cast("string").alias("url"))
    rows = seen.unionByName(runs)
    # All postings are watched from the start.
    first = seen.groupBy("source", "url").agg(F.lit(0).alias("missed_runs"), F.lit(None).cast("long").alias("last_seen_run"))
    store, checkpoint = Snapshots(spark, new_folder(spark, "sightings")), new_folder(spark, "checkpoint")
    store.create("sightings", spark.createDataFrame([], T.SIGHTINGS), ["source", "url"], buckets=4)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        updates = T.sightings(in_batches(spark, rows, "run_id", 5), shards=2, initial=first)
        drained(updates, checkpoint, T.keep_latest(store, "sightings", "runs", ["source", "url"]))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return store.read("sightings").select("source", "url", "missed_runs", "closed")


@query(
    "merges_kept",
    """SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN NULL WHEN p_partkey % 10 = 0 THEN 'new' ELSE 'old' END AS content_hash,
              CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 2 END AS target_attempts, CASE WHEN p_partkey % 10 IN (0, 5) THEN 2 ELSE 1 END AS send_attempts,
              CASE WHEN p_partkey % 10 IN (0, 5) THEN 'sent' ELSE 'failed' END AS status, 1 AS reasons_kept, 4 AS versions
       FROM part WHERE p_partkey % 10 <> 7""",
)
def merges_kept(spark, sf_dir):
    """Merges whose results are written and read back: changed targets, attempts, gates and deletions, in versions of three tables."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey") % 10
    store = Snapshots(spark, new_folder(spark, "merges"))
    store.create("targets", p.select("p_partkey", F.when(k != 3, "old").alias("content_hash"), F.lit(2).alias("attempts"), F.lit(True).alias("hidden")), ["p_partkey"], buckets=8)
    sent = p.select("p_partkey", F.lit(1).cast("long").alias("remote_id"), F.lit("failed").alias("status"), F.lit(1).alias("attempts"), F.lit("t").alias("sent_at"))
    store.create("sent", sent, ["p_partkey"], buckets=8)
    both = p.filter(k.isin(0, 5))
    changes = both.select("p_partkey", F.when(k == 0, "new").otherwise("old").alias("content_hash"))
    tried = both.select("p_partkey", F.lit(None).cast("long").alias("remote_id"), F.lit("sent").alias("status"), F.lit("u").alias("sent_at"))
    store.merge_all({"targets": (changes, lambda old, new: M.retarget(old, new, "p_partkey")), "sent": (tried, lambda old, new: M.record_attempts(old, new, "p_partkey"))}, ("work", 0))
    store.merge("targets", p.filter(k == 7), lambda old, gone: old.join(gone, "p_partkey", "left_anti"), ("work", 1))
    store.merge("targets", p, lambda old, gone: old.limit(0), ("work", 1))  # has gone in before
    joined = store.read("targets").alias("t").join(store.read("sent").alias("s"), "p_partkey")
    return joined.select(
        "p_partkey", "content_hash", F.col("t.attempts").alias("target_attempts"), F.col("s.attempts").alias("send_attempts"), "status",
        F.col("remote_id").cast("int").alias("reasons_kept"), F.lit(store.manifest()["version"]).alias("versions"),
    )
