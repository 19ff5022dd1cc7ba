"""Tables that change by versions, several of them at once.

A folder holds data that is never changed and a small manifest for each version: which folder has each
bucket of each table. A bucket holds the keys with one hash. A merge reads and writes only the buckets
that its changes fall into; a version is published by renaming its finished manifest to the next number, which fails
if another writer was first. So a reader sees one version, whole; a writer that dies leaves the version before it; and
data without a manifest is never read. A version remembers the last batch of each stream that went
into it, so a batch that is played again changes nothing.

    store = Snapshots(spark, "hdfs://.../state")
    store.create("targets", rows, keys=["url"], buckets=64)
    store.merge("targets", changes, lambda old, new: retarget(old, new, "url"))
    store.read("targets")

The driver holds manifests only: a row a bucket. Deal as many buckets as keep one of them small
enough for a task; hot keys do not arise, as a table has one row a key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer has published this version first."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        return self._hadoop.Path(f"{self.path}/{path}")

    @property
    def _files(self):
        return self._at("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder = self._at("manifests")
        names = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest, the last one's by default; version 0 has no tables."""
        found = self.versions()
        version = (found or [0])[-1] if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}, "batches": {}}
        stream = self._files.open(self._at(f"manifests/{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Writes a manifest beside its place and moves it there in one step; a `Conflict` if there is one already."""
        draft = self._at(f"manifests/{uuid.uuid4().hex}.draft")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self._conf)
        never_over = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._at(f"manifests/{manifest['version']:010d}.json"), never_over)
        except Exception as e:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} of {self.path} is there already") from e
            raise

    def batch(self, stream: str) -> int:
        """The last batch of a stream that has gone into this state; -1 before the first."""
        return self.manifest()["batches"].get(stream, -1)

    def read(self, name: str, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """A table of one version; only some of its buckets, if named."""
        return self._rows(self.manifest(version)["tables"][name], buckets)

    def _rows(self, table: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        wanted = table["files"] if buckets is None else {str(b): table["files"][str(b)] for b in buckets if str(b) in table["files"]}
        folders = [f"{self.path}/{entry['folder']}" for entry in wanted.values()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, table: dict):
        return F.pmod(F.xxhash64(*table["keys"]), F.lit(table["buckets"])).cast("int")

    def _write(self, table: dict, rows: DataFrame) -> dict[str, dict]:
        """Files of the buckets of some rows: where they are, how many rows each has, and a sum over them that tells them apart."""
        folder = f"data/{uuid.uuid4().hex}"
        columns = [f["name"] for f in table["schema"]["fields"]]
        rows = rows.select(*columns).withColumn(BUCKET, self._bucket(table))
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(StructType.fromJson(table["schema"]).add(BUCKET, "integer")).parquet(f"{self.path}/{folder}")
        whole = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
        sums = written.groupBy(BUCKET).agg(F.count("*").alias("rows"), F.bit_xor(whole).alias("sum")).collect()  # a row a bucket
        return {str(r[BUCKET]): {"folder": f"{folder}/{BUCKET}={r[BUCKET]}", "rows": r.rows, "sum": r.sum} for r in sums}

    def create(self, name: str, rows: DataFrame, keys: Sequence[str], buckets: int = 16) -> int:
        """Adds a table that is not there yet."""
        now = self.manifest()
        if name in now["tables"]:
            raise ValueError(f"{name} is there already")
        table = {"schema": json.loads(rows.schema.json()), "keys": list(keys), "buckets": buckets, "files": {}}
        for field in table["schema"]["fields"]:
            field["nullable"] = True
        table["files"] = self._write(table, rows)
        self._publish(now | {"version": now["version"] + 1, "tables": now["tables"] | {name: table}})
        return now["version"] + 1

    def merge(self, name: str, changes: DataFrame, merge: Merge, batch: tuple[str, int] | None = None, everywhere: bool = False) -> int:
        """One table's new version: see `merge_all`."""
        return self.merge_all({name: (changes, merge)}, batch, everywhere)

    def merge_all(self, changes: Mapping[str, tuple[DataFrame, Merge]], batch: tuple[str, int] | None = None, everywhere: bool = False) -> int:
        """The version after changes to some tables, each by its merge (old rows, changes) -> new rows.

        A merge gets the old rows of the buckets that its changes fall into, and must leave all others as they are; with
        `everywhere` it gets all rows. Buckets that come out as they went in keep their files. With a batch (stream,
        number) that has gone in before, nothing happens.
        """
        now = self.manifest()
        if batch and batch[1] <= now["batches"].get(batch[0], -1):
            return now["version"]
        tables = dict(now["tables"])
        for name, (rows, merge) in changes.items():
            table = tables[name]
            touched = None if everywhere else [r[0] for r in rows.select(self._bucket(table)).distinct().collect()]  # a row a bucket
            if touched == []:
                continue
            old = table["files"] if touched is None else {str(b): table["files"][str(b)] for b in touched if str(b) in table["files"]}
            new = self._write(table, merge(self._rows(table, touched), rows))
            files = {b: f for b, f in table["files"].items() if b not in old}
            for b, entry in new.items():
                same = b in old and (old[b]["rows"], old[b]["sum"]) == (entry["rows"], entry["sum"])
                files[b] = old[b] if same else entry
            tables[name] = table | {"files": files}
        batches = now["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._publish({"version": now["version"] + 1, "tables": tables, "batches": batches})
        return now["version"] + 1

    def forget(self, keep: int = 2) -> int:
        """Removes old versions but the last `keep`, and data that none of them names. Not while a writer is at work: its data has no
        manifest yet. Gives the number of data folders removed."""
        versions = self.versions()
        for v in versions[:-keep]:
            self._files.delete(self._at(f"manifests/{v:010d}.json"), False)
        named = {entry["folder"] for v in versions[-keep:] for t in self.manifest(v)["tables"].values() for entry in t["files"].values()}
        gone = 0
        for status in self._files.listStatus(self._at("data")):
            for bucket in self._files.listStatus(status.getPath()):
                folder = f"data/{status.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and folder not in named:
                    self._files.delete(bucket.getPath(), True)
                    gone += 1
        return gone
