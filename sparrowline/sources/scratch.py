"""The folder that driver and executors share, for rows that a query writes and reads again."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="sparrowline-")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir; it is removed when the application ends.

    Where that is unset, a local run has a temporary folder. Executors of a cluster would each
    write to their own disk there, so a cluster must name one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{_own_folder(context.applicationId)}"
    folder = f"{named.rstrip('/')}/sparrowline-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows written once to the shared folder and read back: later jobs start from there,
    and a lost executor costs only its own tasks."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
