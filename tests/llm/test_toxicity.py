from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowline.llm import toxicity as T

WORDS = ["ab", "abc", "abcd", "b", "abcde", "zz"]


def plain_matches(lexicon, words):
    spared = set()
    for phrase in lexicon.exceptions:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                spared |= set(range(i, i + len(p)))
    found, at = [], 0
    for i, w in enumerate(words):
        fits = [(len(t), whole, weight) for t, whole, weight in lexicon.entries if (w == t if whole else w.startswith(t))]
        if fits and i not in spared:
            size, _, weight = max(fits)
            found.append((at, weight, w[:size]))
        at += len(w) + 1
    return found


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from(WORDS), st.booleans()), max_size=5, unique=True),
    st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(WORDS)).map(" ".join), max_size=3, unique=True),
    st.lists(st.sampled_from(WORDS + ["abcdef"]), max_size=12),
)
def test_matches_are_brute_force(entries, exceptions, words):
    lexicon = T.Lexicon([(t, whole, float(i + 1)) for i, (t, whole) in enumerate(entries)], exceptions)
    assert T.matches(lexicon, words) == plain_matches(lexicon, words)


def test_folding():
    assert T.folded("Ìdіот, 1D10T!! stуpid ｓｃｕｍ id!ot cl0wn$ l@ser") == [
        "idiot", "idiot", "stypid", "scum", "idiot", "clown", "laser",
    ]
    assert T.folded(None) == T.folded(" \n") == [] and T.folded("áé") == ["ae"]


def corpus(rng, n=700):
    vocabulary = ["".join(rng.choice(["an", "the", "ri", "ou", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.25
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["grobnik", "Zlyden!", "zlyden", "fudwort", "fudwort"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t, _ in rows], "doc_id long, text string, lang string, score int, toxic string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(1))
    rows.append((5000, " ".join(["ri an ou"] * 20 + ["gr0bn1k ZLYDEN fudwort"]), 1))  # disguised
    docs, labels = frames(spark, rows)
    found = {r.doc_id: r for r in T.score(docs, labels).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    assert all(found[i].held_out == held_out(i) for i, _, _ in rows)
    test = [(found[i].predicted, x) for i, _, x in rows if held_out(i)]
    assert sum(p == x for p, x in test) / len(test) > 0.95
    assert found[5000].predicted == 1
    kept = T.filtered(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if not r.predicted}


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = corpus(random.Random(2), 300)
    docs, labels = frames(spark, rows)
    turned = [(i, t, 1 - x if held_out(i) else x) for i, t, x in rows]
    score = lambda f: sorted((r.doc_id, r.score) for r in T.score(*f).collect())
    assert score((docs, labels)) == score(frames(spark, turned))


def test_odd_rows(spark):
    docs, labels = frames(spark, [(1, None, 1), (2, "", 0), (None, "x", None), (3, "y " * 50000, 0), (3, "z", 1)])
    found = T.score(docs, labels).collect()
    assert len(found) == 5 and {r.held_out for r in found if r.doc_id is None} == {False}
    assert T.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in T.score(docs, labels.limit(0)).collect()} == {0.0}


def test_only_near_copies_count_once(spark):
    texts = [f"aa {' '.join(f'w{i}x{k}' for k in range(60))} zz" for i in range(5)]
    hashes = spark.createDataFrame([(w,) for t in texts for w in t.split()], "w string").selectExpr("w", "xxhash64(w) h").distinct().orderBy("h").collect()
    ends = f"{hashes[0].w} {hashes[-1].w}"  # every text holds the smallest and the largest hash of a word
    rows = [(i, f"{t} {ends}", 1) for i, t in enumerate(texts)] + [(9, f"{texts[0]}  {ends}", 1), (10, f"{texts[0]} {ends}", 0)]
    found = T.distinct_texts(spark.createDataFrame(rows, "doc_id long, text string, toxic int")).collect()
    assert sorted((r.text, r.toxic) for r in found) == sorted((t, c) for i, t, c in rows if i != 9)


def test_entries_and_exceptions_are_those_of_plain_counts(spark):
    """Counts, likelihood ratio, odds and exceptions by dictionaries over the rows that words are learned from."""
    rows = corpus(random.Random(4), 900)
    docs, labels = frames(spark, rows)
    lexicon = T.learn(docs, labels)
    marked = spark.createDataFrame([(i,) for i, _, _ in rows], "doc_id long").selectExpr("doc_id", "pmod(xxhash64(doc_id, 'curve'), 3) = 0 AS curve").collect()
    curve = {r.doc_id for r in marked if r.curve}
    first = {}
    for i, t, x in rows:
        if not held_out(i) and i not in curve:
            first.setdefault((T.fingerprint(t.encode()), x), t)
    used = [(T.folded(t), x) for (_, x), t in first.items()]
    size = Counter(x for _, x in used)
    count = {}
    for words, x in used:
        terms = {w + " " for w in words if len(w) >= 3} | {w[:k] for w in words for k in range(4, 11) if k < len(w)}
        for term in terms:
            count.setdefault(term, [0, 0])[x] += 1

    def odds(c, t):
        return math.log((t + 0.5) / (size[1] + 1)) - math.log((c + 0.5) / (size[0] + 1))

    def ratio(c, t):
        n, share = c + t, lambda k: size[k] / (size[0] + size[1])
        return 2 * (t * math.log(max(t, 0.5) / (n * share(1))) + c * math.log(max(c, 0.5) / (n * share(0))))

    want = {e: odds(*ct) for e, ct in count.items() if ct[1] >= T.LEAST_DOCS and ratio(*ct) >= T.LEAST_RATIO and odds(*ct) >= T.LEAST_ODDS}
    found = {text + " " * whole: w for text, whole, w in lexicon.entries}
    seeds = {T.folded(s)[0] + " " for s in T.SEEDS}
    assert set(want) <= set(found) <= set(want) | seeds and len(want) > 3
    assert all(math.isclose(found[e], w, abs_tol=1e-9) for e, w in want.items())
    assert all(e in seeds or e in want for e in found)
    plain = T.Lexicon(lexicon.entries)
    near = {}
    for words, x in used:
        text = " ".join(words)
        starts = {len(" ".join(words[:k])) + (k > 0): k for k in range(len(words))}
        hit = {starts[at] for at, _, _ in T.matches(plain, words)}
        assert all(text.startswith(words[k], len(" ".join(words[:k])) + (k > 0)) for k in hit)
        for pair in {f"{words[j]} {words[j + 1]}" for k in hit for j in (k - 1, k) if 0 <= j < len(words) - 1}:
            near.setdefault(pair, [0, 0])[x] += 1
    assert lexicon.exceptions == sorted(p for p, (c, t) in near.items() if c >= T.LEAST_DOCS and odds(c, t) < 0)
