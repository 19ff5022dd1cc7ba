"""Reading the tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder; Spark's reader opens any store."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, its rows dealt evenly to all cores, for columns that cost much a row, such as those over pages.

    A file of one row group is one task, however long its rows are worked on: a million parts are 9 MB. A table that has several
    splits for each core is left as it is.
    """
    rows = table(spark, sf_dir, name)
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)
