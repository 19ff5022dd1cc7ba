"""Patterns against Python's own answer, copied pieces against a plain search, spans of pages against slices."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowline.functions import delivery, html, spans
from sparrowline.functions.patterns import java_pattern, java_replacement, substituted
from sparrowline.operators import grounding as G
from sparrowline.operators import rules as U

SIGNS = list("ab1 _-[]&$\n\té가 İ^{},.") + ["\U0001f600", "\x1c", "\xa0"]


def random_pattern(rng, depth=0):
    def one():
        at = rng.random()
        if at < 0.35:
            return re.escape(rng.choice(SIGNS))
        if at < 0.5:
            return rng.choice([r"\d", r"\w", r"\s", r"\D", r"\W", r"\S", "."])
        if at < 0.7:
            inside = "".join(rng.choice(["a-b", "1", "[", "&&", "é", r"\d", r"\S", r"\]", "^", "-", " ", r"\w"]) for _ in range(rng.randrange(1, 4)))
            inside = inside[1:] + inside[0] if inside[0] == "^" and len(inside) > 1 else inside
            return f"[{rng.choice(['', '', '^'])}{inside if inside not in '^' else 'a'}]"
        if at < 0.78:
            return rng.choice([r"\b", r"\B", "^", "$", r"\A", r"\Z"])
        if depth < 2:
            inner = random_pattern(rng, depth + 1)
            return rng.choice(["(%s)", "(?:%s)", "(?=%s)", "(?!%s)", "(?>%s)", "(?s:%s)", "(?:%s|b)"]) % inner
        return "a"

    out = ""
    for _ in range(rng.randrange(1, 4)):
        piece = one()
        if rng.random() < 0.35 and not piece.startswith((r"\b", r"\B", "^", "$", r"\A", r"\Z", "(?=", "(?!")):
            piece += rng.choice(["*", "+", "?", "{,2}", "{2}", "{1,}", "*?", "+?", "?+", "{0,1}+"])
        out += piece
    return rng.choice(["", "", "", "(?m)", "(?s)", "(?i)"]) + out if depth == 0 else out


@pytest.mark.filterwarnings("ignore")
def test_patterns_give_pythons_answer(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(12))) for _ in range(60)] + ["", "ab\n", "aaaa", "[a]&&b"]
    patterns = []
    while len(patterns) < 300:
        p = random_pattern(rng)
        try:
            re.compile(p)
        except re.error:
            continue
        patterns.append(p)
    by_jvm = sum(java_pattern(p) is not None for p in patterns)
    assert by_jvm > 120
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for some in (patterns[k : k + 100] for k in range(0, 300, 100)):
        new = [r"<\g<0>$1\\>" if rng.random() < 0.5 else "-" for _ in some]
        found = frame.select("i", *[substituted(F.col("t"), p, r).alias(f"p{k}") for k, (p, r) in enumerate(zip(some, new))]).collect()
        for row in found:
            for k, (p, r) in enumerate(zip(some, new)):
                assert row[f"p{k}"] == re.sub(p, r, texts[row.i]), (p, r, texts[row.i])


def test_replacements_are_pythons():
    assert java_replacement("(a)(?P<n>b)", r"\2$\g<n>\\1\n") == "$2\\$$2\\\\\\1\n"
    for pattern, new in (("a", r"\1"), ("a", r"\q"), ("(", "x")):
        with pytest.raises(ValueError):
            java_pattern(pattern)
            java_replacement(pattern, new)
    assert java_pattern("(a)?(?(1)b|c)") is None and java_pattern("(?i)a") is None


def test_a_rule_that_is_refused_is_refused_when_it_is_read():
    for pattern, new in (("a{2,1}", ""), ("(a", ""), ("a", r"\3"), ("(?P<x>a)", r"\g<y>")):
        with pytest.raises(U.RuleError):
            U.read_rule({"id": 1, "field_name": "f", "rule_type": "regex", "priority": 1, "enabled": 1, "rule_config_json": __import__("json").dumps({"pattern": pattern, "replacement": new})})


def test_long_texts_do_not_exhaust_the_stack(spark):
    long = spark.range(1).select(F.repeat(F.lit("ab1é "), 200_000).alias("t"))
    found = long.select(*[F.length(substituted(F.col("t"), p, "")).alias(f"n{i}") for i, p in enumerate([r"\S+", r"[\w ]+", r"[^\n]+", r".*?1"])]).first()
    assert list(found) == [200_000, 0, 0, 2]


@pytest.mark.parametrize("value", ["IT\n", "\tIT", "　IT\x1c", "\r\n IT  "])
def test_answers_are_stripped(spark, value):
    row = spark.range(1).select(G.judged(F.lit(value), F.lit(value), F.lit("IT"), ["IT"]).alias("j"), G.counted(F.lit(value.replace("IT", "3")), F.lit("3 years\n"), F.lit("3 years")).alias("c")).first()
    assert (row.j.value, row.j.reason, row.c.value, row.c.reason) == ("IT", None, "3", None)


def plain_located(line, piece):
    """The first part of a line that folds to the same, found by trying every span."""
    want = spans.folded(piece)[0]
    text, places = spans.folded(line)
    at = text.find(want) if len(want) >= 2 else -1
    return None if at < 0 else (places[at], places[at + len(want) - 1] + 1)


def test_pieces_are_found_as_a_plain_search_finds_them():
    rng = random.Random(1)
    words = ["C++", "C#", "C", "10%", "10", "(must)", "[a", "b]", "서울", "İx", "a.b", "-", "“q”", "R&D", "x_y"]
    for _ in range(300):
        lines = [" ".join(rng.choices(words, k=rng.randrange(6))) for _ in range(rng.randrange(1, 6))]
        pieces = [(rng.randrange(-1, 7), " ".join(rng.choices(words, k=rng.randrange(1, 3)))) for _ in range(8)]
        want = []
        for n, piece in pieces:
            if not spans.folded(piece)[0]:
                continue
            pointed = lines[n] if 0 <= n < len(lines) else ""
            span, text = None, None
            for line in [pointed, *lines]:
                if span := plain_located(line, piece):
                    text = spans.widened(line, *span, piece)
                    break
            want.append((text, "exact") if span else (pointed or None, "line" if pointed else "lost"))
        assert [tuple(p) for p in spans.resolve(lines, pieces)] == want


def test_signs_that_matter_and_marks_that_stand_around():
    assert spans.located("C++ developer wanted", "C# developer wanted") is None and spans.located("10% more", "10") == "10"
    assert spans.located("pay rises 10% a year", "10% A YEAR") == "10% a year" and spans.located("R&D lead", "RD lead") is None
    assert spans.located("office: main (3rd floor).", "main 3rd floor") == "main (3rd floor)"
    assert spans.located("office: main (3rd floor).", "Main (3rd floor.") == "main (3rd floor)"
    assert spans.located('say "yes!" now', '"Yes!"') == '"yes!"' and spans.located("[Team A] lead", "Team A") == "Team A"
    assert [p.how for p in spans.resolve(["title", "one line"], [(1, "other words"), (7, "nowhere"), (0, "-")])] == ["line", "lost"]


def test_many_pieces_cost_no_more_than_their_length():
    import time

    lines = [f"line {i} of a long source, with words" for i in range(20_000)]
    began = time.perf_counter()
    found = spans.resolve(lines, [(i, f"LINE {i} of a long") for i in range(0, 20_000, 2)])
    assert all(p.how == "exact" for p in found) and time.perf_counter() - began < 8


def test_repeats_of_deep_pages_take_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        assert delivery.cleaned("".join(f"<div>step {i} of many words " for i in range(n)), "https://x.example/")
        return time.perf_counter() - began

    seconds(200)
    assert seconds(8_000) < 25 * max(seconds(800), 0.02)


def test_spans_are_equal_where_slices_are():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 3, 300).astype(np.uint32)
    s = delivery._Spans(codes)
    cuts = [sorted(rng.integers(0, 301, 2)) for _ in range(400)]
    for (a, b), (c, d) in zip(cuts, cuts[::-1]):
        assert (s.key(a, b) == s.key(c, d)) == (codes[a:b].tolist() == codes[c:d].tolist())


def test_payload_markup_and_pages_keep_their_lines():
    said = html.html_text.plain
    assert said("a &amp; b<br>c") == "a & b\nc" and said("<p>a</p><p>&nbsp;</p><p>b</p>") == "a\nb" and said("<p>a</p><p><br>&nbsp;</p>") == "a"
    assert said("<p>a\n\n\n\nb</p>") == "a\n\nb" and said("<p><span>a</span><b>b</b>c&nbsp;d</p>") == "abc d" and said("<p>&nbsp;</p>") == ""
    assert said("R&D  \n as it is ") == "R&D  \n as it is " and said("<!-- x --><p style='a'>&lt;a&gt;</p>") == "<a>"
    assert delivery.cleaned("<div style='white-space: pre-line'>\n\none\n \n\n two\nthree\n</div>", "https://x.example/") == "<div>one<br><br> two<br>three</div>"
    assert delivery.cleaned("<img src=' ' data-src='/a.png' alt=''><a href='mailto:x@y.z'>m</a><a href='ftp://x'>f</a>", "https://x.example/b/") == '<img src="https://x.example/a.png" alt=""><a href="mailto:x@y.z">m</a>f'
