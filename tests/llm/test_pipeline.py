"""The stages of the pipeline: what each keeps, odd rows, and the rows of the whole."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparrowline.llm import near_duplicates, packing, simhash, toxicity
from sparrowline.llm.common import matched

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = " ".join(f"word{i}" for i in range(80))
STAGES = dict(corpus_pipeline.STAGES)

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def odd_rows(spark):
    rows = [
        (1, TEXT, "en", "a", 1),
        (2, TEXT, "en", "b", 1),  # a copy
        (2, TEXT, "en", "b", 1),  # repeated
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (None, "somewhere else entirely and not like others", "de", "a", 5),
        (5, "one", "en", None, 3),
        (6, " ".join(f"t{i * 7919 % 100003}" for i in range(200_000)), "en", "a", 9),
    ]
    return spark.createDataFrame(rows, KINDS)


def with_clashes(docs):
    """Extra columns before and after, one that differs from `text` in case only."""
    return docs.select(F.lit("x").alias("TEXT"), "*", F.lit(7).alias("rank"), F.lit(8).alias("_key"))


@needs_tables
@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "mixing"])
def test_a_stage_returns_the_columns_of_its_input(spark, name):
    empty = odd_rows(spark).limit(0)
    found = STAGES[name](spark, empty, SF)
    assert found.columns == empty.columns and found.count() == 0
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = with_clashes(odd_rows(spark))
        found = STAGES[name](spark, docs, SF)
        assert found.columns == docs.columns
        assert {tuple(r) for r in found.collect()} <= {tuple(r) for r in docs.collect()}
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_one_of_each_group_stays(spark):
    kept = Counter(r.doc_id for r in simhash.deduplicate(odd_rows(spark)).collect())
    # null and empty text are one group (fingerprint zero)
    assert kept == Counter([1, 3, None, 5, 6])


@needs_tables
def test_packing_takes_odd_and_no_rows(spark):
    docs = with_clashes(odd_rows(spark).withColumnRenamed("lang", "bucket"))
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        found = STAGES["packing"](spark, docs, SF).collect()
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert Counter(r.doc_id for r in found) == Counter([1, 2, 2, 3, 4, None, 5, 6])
    assert {r.n_tokens for r in found if r.doc_id in (3, 4)} == {0}
    assert STAGES["packing"](spark, odd_rows(spark).limit(0), SF).count() == 0


@needs_tables
def test_the_whole_is_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = {(r.doc_id, r.predicted) for r in toxicity.score(docs, labels).collect()}
    clean = {d for d, p in judged if p == 0}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in clean}
    shingles = {d: near_duplicates.shingle_hashes(None if t is None else t.encode()) for d, t in texts.items()}
    sets = {d: set(s.tolist()) for d, s in shingles.items()}
    alike = {
        (a, b) for a in sets for b in sets
        if len(sets[a] & sets[b]) >= near_duplicates.SIMILARITY * len(sets[a] | sets[b])
    }
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in root:
            for b in root:
                if (a, b) in alike and root[b] < root[a]:
                    root[a], changed = root[b], True
    kept = {d for d in root if root[d] == d}
    assert 0 < len(kept) < len(clean) <= len(judged)

    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} <= kept
    sizes = {d: len((texts[d] or "").split()) for d in kept}
    taken = Counter(r.doc_id for r in rows)
    assert max(taken.values()) <= 2
    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect() if r.doc_id in kept}
    by_source = {s: sum(sizes[d] for d in kept if sources[d] == s) for s in set(sources.values())}
    goal = 1.5 * sum(by_source.values())
    assert abs(sum(taken[d] * sizes[d] for d in taken) - goal) <= 2 * max(sizes.values()) * len(by_source)
    for r in rows:
        assert r.padding == r.padded_length - r.n_tokens >= 0
    held = Counter((r.bucket, r.batch) for r in rows)
    for r in rows:
        assert held[r.bucket, r.batch] * r.padded_length <= max(65536, r.padded_length)
    assert all(texts[r.doc_id] == r.text and sources[r.doc_id] == r.source for r in rows)
    assert {r.copy for r in rows} <= {1, 2}
    assert {*packing.pack(docs).columns, "text", "source", "copy"} == set(rows[0].asDict())


def test_frequent_keys_are_joined_like_others(spark):
    rows = spark.range(10_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    found = matched(rows, table, ["k"], "n").collect()
    assert sorted(r.id for r in found) == list(range(10_000))
    assert all(r.least == (0 if r.id % 3 == 0 else r.id) for r in found)
