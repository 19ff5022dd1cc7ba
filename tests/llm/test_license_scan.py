from __future__ import annotations

import random
import re

import pytest

from sparrowline.llm import license_scan as L
from sparrowline.llm.license_texts import PHRASES, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    words = plain_words(text)
    starts, labels = [], set()
    for label, phrase in PHRASES:
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), labels


def sample(rng):
    pool = [w for _, t in TEMPLATES for w in plain_words(t)] + ["é", "漢字", "zzz", "CC", "by"]
    parts = []
    for _ in range(rng.randint(0, 60)):
        kind = rng.random()
        if kind < 0.15:
            parts.append(rng.choice(PHRASES)[1].upper())
        elif kind < 0.25:
            words = rng.choice(TEMPLATES)[1].split()
            at = rng.randrange(len(words))
            parts.append(" ".join(words[at : at + rng.randint(1, 30)]))
        else:
            parts.append(rng.choice(pool))
    return rng.choice([" ", "\n", ", ", "-"]).join(parts)


def longest(words, at, sequences):
    return max((n for n in range(1, at + 2) for s in sequences if "\0".join(["", *words[at + 1 - n : at + 1], ""]) in s), default=0)


def test_phrases_are_brute_force_whatever_the_pieces(monkeypatch):
    rng = random.Random(5)
    scan = L.scanner()
    for piece in (1 << 20, 40):
        monkeypatch.setattr(L, "PIECE", piece)
        for text in [None, "", "!!", "MIT License", "gnu general public gnu general public license", *(sample(rng) for _ in range(300))]:
            f = scan.scan(None if text is None else text.encode())
            assert (f.words, f.base, f.first, f.last, f.base_labels) == plain_base(text)


def test_matching_statistics_are_brute_force():
    rng = random.Random(6)
    scan = L.scanner()
    sequences = ["\0".join(["", *plain_words(t), ""]) for _, t in [*TEMPLATES, *PHRASES]]
    for _ in range(40):
        words = plain_words(sample(rng))
        state = matched = 0
        for i, w in enumerate(words):
            state, matched = scan.automaton.step(state, matched, scan.ids.get(w.encode(), 0))
            assert matched == longest(words, i, sequences)


def test_pieces_find_the_same_anchors(monkeypatch):
    rng = random.Random(7)
    texts = [sample(rng).encode() for _ in range(100)]
    whole = [L.scanner().scan(t).anchors for t in texts]
    monkeypatch.setattr(L, "PIECE", 64)
    assert [L.scanner().scan(t).anchors for t in texts] == whole


def test_templates_with_gaps_get_labels():
    scan = L.scanner()
    for label, t in TEMPLATES:
        words = t.split()
        if len(words) > 20:
            words[10:11] = ["something", "else"]
        shares = scan.covered(scan.scan(("Some text before. " + " ".join(words) + " and after").encode()))
        assert shares[label] >= L.COVERED
    assert scan.covered(scan.scan(b"the quick brown fox is free of charge to any person")).get("mit", 0) < L.COVERED


def test_rows_in_and_out(spark):
    rows = [(1, "Released under the MIT License."), (2, None), (3, ""), (None, "cc by"), (1, "Released under the MIT License."),
            (4, "filler " * 200000 + "Licensed under the Apache License, Version 2.0.")]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, score int, Text string")
    found = L.scan(docs).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert (by[1].labels, by[1].n_base, by[1].score) == ("mit", 1, 1.0)
    assert (by[2].n_words, by[2].first_word, by[2].labels, by[2].score) == (0, None, "", 0.0)
    assert by[4].first_word == 200003 and by[4].labels == "apache"
    assert L.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,labels",
    [
        ("this package is released under the BSD License", ""),
        ("released under the terms that follow", ""),
        ("Released under the MIT License.", "mit"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
        ("This work is licensed under a commercial agreement, version 3", ""),
        ("This work is licensed under the GNU Free Documentation License, version 3", ""),
        ("you may not use this file except in compliance with the License. You may obtain a copy of the License at example.com", ""),
    ],
)
def test_wordings_of_other_licenses_give_no_label(text, labels):
    scan = L.Scanner()
    found = scan.scan(text.encode())
    shares = scan.covered(found)
    assert ",".join(sorted(found.base_labels | {k for k, s in shares.items() if s >= L.COVERED})) == labels
