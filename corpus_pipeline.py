"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, sources
are mixed to their target weights, and what the mix takes is packed.

Each stage is written as Parquet to the shared folder and read again as the next one's input. The
folder goes when the application ends. In every stage extra columns are kept or, in the last, left
out, whatever they are called; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparrowline.llm.common import new_folder, read_table
from sparrowline.llm.mixing import mixed
from sparrowline.llm.near_duplicates import deduplicate
from sparrowline.llm.packing import packed
from sparrowline.llm.toxicity import filtered


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic, by what is learned from `labels`.

    A null or empty text has the score of no words; repeated rows are judged alike; without training rows all stay.
    """
    return filtered(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their five-word shingles, the one with the smallest id.

    Null and empty texts are one group; a null id comes after all others; of repeated rows one stays, the same at each run.
    """
    return deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null is a source of its own; a source without words gives nothing; of rows equal in id and text
    one stands for all, with the copies of all.
    """
    return mixed(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, source, which copy it is, and its place in a batch of a length bucket.

    A null text has no words; a document longer than a batch is one by itself; equal lengths share a bucket.
    """
    return packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

#: The lexicon is learned and texts are hashed with XXH64, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table of documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
