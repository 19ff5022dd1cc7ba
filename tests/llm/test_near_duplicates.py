from __future__ import annotations

import random

import numpy as np
import pytest

from sparrowline.llm import near_duplicates as N

KINDS = "doc_id long, text string, extra map<string,int>"


def text_of(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def copies(rng, base, m):
    """Texts that differ from the base in one to three words."""
    out = []
    for _ in range(m):
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        out.append(words)
    return out


def plain_jaccard(x, y):
    a, b = ({tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in (x, y))
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    texts = []
    for _ in range(120):
        base = text_of(rng, rng.randint(60, 400))
        texts += [base, *copies(rng, base, rng.choice([1, 2, 5]))]
    hot = text_of(rng, 300)
    return texts + [hot, *copies(rng, hot, 150)] + [text_of(rng, 200) for _ in range(400)]


def test_jaccard_is_that_of_shingle_sets(corpus):
    for x, y in zip(corpus[:60], corpus[1:61]):
        assert N.jaccard(" ".join(x).encode(), " ".join(y).encode()) == plain_jaccard(x, y)
    assert N.jaccard(None, b"") == 1.0 and N.jaccard(b"a", None) == 0.0 and N.jaccard(b"A b", b"a B") == 1.0


@pytest.mark.parametrize("bucket", [4096, 16])
def test_nearly_all_similar_pairs_share_a_group_and_no_others(spark, corpus, monkeypatch, bucket):
    """With one bucket and with many small ones in tables."""
    masks = N.table_masks
    monkeypatch.setattr(N, "table_masks", lambda n: masks(n, bucket))
    docs = spark.createDataFrame([(i, " ".join(t), {"a": 1}) for i, t in enumerate(corpus)], KINDS)
    root = {r.doc_id: r.root for r in N.groups(docs).collect()}
    n = len(corpus)
    similar = [(i, j) for i in range(n) for j in range(i) if len(set(corpus[i]) & set(corpus[j])) > 30 and plain_jaccard(corpus[i], corpus[j]) >= 0.8]
    assert len(similar) > 1000
    assert sum(root[i] == root[j] for i, j in similar) >= 0.97 * len(similar)
    link = list(range(n))
    for i, j in similar:  # components of the true links
        a, b = link[i], link[j]
        link = [min(a, b) if x in (a, b) else x for x in link] if a != b else link
    assert all(len({link[i] for i in range(n) if root[i] == r}) == 1 for r in set(root.values()))
    kept = [r.doc_id for r in N.deduplicate(docs).collect()]
    assert len(kept) == len(set(root.values()))


def test_tables_grow_with_the_corpus():
    assert N.table_masks(150) == [0]
    sizes = [(bin(m[0]).count("1"), len(m)) for m in map(N.table_masks, (10**4, 10**6, 10**9))]
    assert sizes == sorted(sizes) and sizes[0][0] >= 4
    rng = np.random.default_rng(0)  # pairs at REACH of 128 bits meet in one of the tables
    masks, met = N.table_masks(10**5), 0
    for _ in range(400):
        differing = sum(1 << int(b) for b in rng.choice(128, N.REACH, replace=False))
        met += any(not m & differing for m in masks)
    assert met >= 0.9 * 400


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", {"a": 1}), (1, "a b c d e f", {"a": 2}), (2, None, None), (3, "", None), (None, "a b c d e f", None), (None, None, None)]
    docs = spark.createDataFrame(rows, KINDS)
    first = N.deduplicate(docs).collect()
    assert sorted(r.doc_id for r in first) == [1, 2]
    assert first == N.deduplicate(docs.repartition(3)).collect() or sorted(map(str, first)) == sorted(map(str, N.deduplicate(docs.repartition(3)).collect()))
    assert N.deduplicate(docs.limit(0)).count() == 0


def test_nearer_classes_between_hide_no_pair(spark, monkeypatch):
    """x has a class nearer to it than y that is not similar enough; x and y are, and no other link joins them."""
    monkeypatch.setattr(N, "jaccard", lambda x, y: 1.0 if {bytes(x), bytes(y)} == {b"x", b"y"} else 0.0)
    prints = {b"x": (0, 0), b"y": (0, 0b11111), b"z": (0, 0b1), b"u": (0, 0b10111)}
    monkeypatch.setattr(N, "fingerprint_words", lambda t, *_: np.array(prints[bytes(t)], dtype="<u8"))
    monkeypatch.setattr(N, "_fingerprint_batches", _with(N._fingerprint_batches, N.fingerprint_words, "fingerprint_words"))
    monkeypatch.setattr(N, "_confirm_batches", _with(N._confirm_batches, N.jaccard, "jaccard"))
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate("xyzu")], KINDS)
    root = {r.doc_id: r.root for r in N.groups(docs).collect()}
    assert root[0] == root[1] and len(set(root.values())) == 3


@pytest.mark.parametrize("chunk, bucket", [(256, 4096), (64, 32)])
def test_a_family_that_is_near_but_not_joined_makes_no_row_a_pair(spark, monkeypatch, chunk, bucket):
    """Texts near one base, many pairs of which are within RADIUS and not similar enough: all are compared, none is a row."""
    monkeypatch.setattr(N, "CHUNK", chunk)
    masks = N.table_masks
    monkeypatch.setattr(N, "table_masks", lambda n: masks(n, bucket))
    rng = random.Random(8)
    base, texts = text_of(rng, 150), []
    for _ in range(260):
        words = list(base)
        for _ in range(rng.randint(2, 7)):
            words[rng.randrange(150)] = f"x{rng.randrange(9999)}"
        texts.append(words)
    made, keep = {}, N.written

    def counted(df, what):
        found = keep(df, what)
        made[what] = max(made.get(what, 0), found.count())
        return found

    monkeypatch.setattr(N, "written", counted)
    docs = spark.createDataFrame([(i, " ".join(t), None) for i, t in enumerate(texts)], KINDS)
    root = {r.doc_id: r.root for r in N.groups(docs).collect()}
    prints = np.array([N.fingerprint_words(" ".join(t).encode(), 5, N.xxh3_128) for t in texts])
    tables = N.table_masks(260)
    pairs = [
        (i, j) for i in range(260) for j in range(i)
        if np.bitwise_count(prints[i] ^ prints[j]).sum() <= N.RADIUS and any(not int(prints[i][0] ^ prints[j][0]) & m for m in tables)
    ]
    link = list(range(260))
    for i, j in pairs:
        if plain_jaccard(texts[i], texts[j]) >= 0.8:
            a, b = link[i], link[j]
            link = [min(a, b) if x in (a, b) else x for x in link] if a != b else link
    assert len({(link[i], root[i]) for i in range(260)}) == len(set(link)) == len(set(root.values()))
    apart = sum(link[i] != link[j] for i, j in pairs)
    assert apart > 3000 > max(made.values()) and made["rest"] <= 260 * len(tables)


def _with(f, value, name):
    """`f` with another value of a global, in the workers as well."""
    import types

    made = types.FunctionType(f.__code__, f.__globals__ | {name: value}, f.__name__, f.__defaults__, f.__closure__)
    made.__module__ = "__main__"  # sent whole, not by its name
    return made
