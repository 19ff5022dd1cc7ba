"""Every operator over empty tables, nulls, repeated rows, very long texts and clashing columns."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparrowline.llm import ann, chat_format, exact_topk, license_scan, mixing, packing, simhash, token_files, toxicity, url_filter

DOCS = "doc_id long, text string, source string"
LONG = " ".join(f"w{i % 977} mit license" if i % 50_000 == 0 else f"w{i % 977}" for i in range(300_000))
ROWS = [(1, "plain text of five words", "a"), (1, "plain text of five words", "a"), (2, None, None), (None, "", "b"), (None, None, None), (3, LONG, "a")]
LABELS = "doc_id long, toxic int"


@pytest.fixture
def exact_names(spark):
    """Tables can have columns that differ in case only."""
    spark.conf.set("spark.sql.caseSensitive", "true")
    yield
    spark.conf.unset("spark.sql.caseSensitive")


def with_clashes(df):
    """Extra columns that are named like ones that operators make or read."""
    named = {c.upper(): F.lit(1) for c in df.columns} | {c: F.lit(2) for c in ("rank", "score", "_key", "size", "fp", "text_hash", "list", "number")}
    return df.select(*[v.alias(k) for k, v in named.items()], "*")


def no_labels(spark):
    return spark.createDataFrame([], LABELS)


def token_rows(spark, docs):
    public = pytest.importorskip("public_tokenizers")
    return token_files.read(token_files.write(docs, public.path("byte_bpe_50k.json"), end_id=2))


ON_DOCS = {
    "mixing": lambda spark, docs: mixing.mix(docs),
    "license_scan": lambda spark, docs: license_scan.scan(docs),
    "toxicity": lambda spark, docs: toxicity.score(docs, no_labels(spark)),
    "simhash": lambda spark, docs: simhash.clusters(docs),
    "token_files": token_rows,
    "packing": lambda spark, docs: packing.pack(docs),
}


@pytest.mark.parametrize("name", ON_DOCS)
def test_documents(spark, exact_names, name):
    run = ON_DOCS[name]
    docs = spark.createDataFrame(ROWS, DOCS)
    found = run(spark, with_clashes(docs)).collect()
    assert Counter(r.doc_id for r in found) == Counter([1, 1, 2, None, None, 3])
    assert run(spark, docs.limit(0)).count() == 0


def test_whole_texts_are_read(spark):
    docs = spark.createDataFrame(ROWS[-1:], DOCS)
    scanned = license_scan.scan(docs).first()
    assert (scanned.n_words, scanned.n_base, scanned.labels) == (300_012, 6, "mit")
    assert mixing.mix(docs).first()["size"] == packing.pack(docs).first().n_tokens == 300_012
    assert simhash.clusters(docs).first().fp & (2**64 - 1) == simhash.fingerprint(LONG.encode())


def test_conversations(spark, exact_names):
    kinds = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (2, None, "assistant", None), (2, 1, None, LONG)]
    chats = spark.createDataFrame(rows, kinds)
    found = {r.conv_id: r for r in chat_format.digests(chat_format.format_chats(with_clashes(chats))).collect()}
    assert {c: r.n_turns for c, r in found.items()} == {1: 2, None: 1, 2: 2}
    assert found[2].loss_chars == 0 and found[2].formatted_chars > len(LONG)
    assert chat_format.digests(chat_format.format_chats(chats.limit(0))).count() == 0


def test_urls(spark, exact_names):
    pages = spark.createDataFrame([(1, None), (1, None), (None, "https://A.net/de/1"), (2, "x" * 200_000), (3, "://"), (4, "")], "page_id long, url string")
    found = url_filter.judge(with_clashes(pages)).collect()
    assert Counter(r.page_id for r in found) == Counter([1, 1, None, 2, 3, 4])
    assert all(r.verdict in ("allow", "block") and r.host is not None and r.path is not None for r in found)
    assert {(r.host, r.path, r.rule) for r in found} == {("", "", None), ("a.net", "/de/1", "net/de/")}
    assert url_filter.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("search", [ann.search, exact_topk.search])
def test_vectors(spark, exact_names, search):
    kinds = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 0.5]), (20, [0.5, 0.5]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [float("nan"), 1.0]),
            (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, []), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, kinds)
    found = {(r.query_id, r.rank): r.vec_id for r in search(with_clashes(vectors)).collect()}
    assert found == {(0, 1): 1, (0, 2): 2, (0, 3): 20, (20, 1): 1, (20, 2): 2, (20, 3): 0}
    assert search(vectors.limit(0)).count() == 0
    assert search(vectors.filter("vec_id = 1")).count() == 0
