"""Grounding, answers, reviews, merges and pages at their edges; the named queries hold the rest against SQL."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparrowline.functions import pages as P
from sparrowline.functions.html import parse, select
from sparrowline.operators import answers as A
from sparrowline.operators import grounding as G
from sparrowline.operators import inference as I
from sparrowline.operators import merge as M
from sparrowline.operators import review as V
from sparrowline.operators import rules as U


@pytest.fixture
def value(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first().v


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


def test_nothing_given_is_nothing_dropped(value):
    for check in (G.extracted(lit(None), lit("s")), G.judged(lit(" "), lit(None), lit(None), ["a"]), G.counted(lit(""), lit("q"), lit("q")), G.addressed(lit(None), lit(None))):
        assert tuple(value(check)) == ("", None, None)
    assert value(G.counted(lit("007"), lit("7 years"), lit("7 years"))).reason == G.NOT_A_NUMBER
    assert tuple(value(G.counted(lit("05"), lit("five years"), lit("Five   YEARS")))) == ("5", None, "five years")
    assert tuple(value(G.addressed(lit("mail: A@b.co.kr"), lit("a@B.CO.KR")))) == ("A@b.co.kr", None, None)
    assert value(G.judged(lit("a"), lit("elsewhere"), lit("here"), ["a"])).evidence is None


def test_answers_of_all_shapes(spark):
    given = {
        None: ("unparsable", None), "[]": ("unparsable", None), '"x"': ("unparsable", None), "{": ("unparsable", None), "{}": (None, []),
        '{"postings":null}': (None, []), '{"postings":{"a":1}}': ("unparsable", None), '{"postings":[{}]}': (None, [{}]),
        '{"role":"r"}': (None, [{"role": "r"}]), '{"role":"top","common":{"role":"in"},"postings":[{}]}': (None, [{"role": "in"}]),
        '{"postings":[{"role_evidence":"e","role":1}]}': (None, [{"role": "1"}]), '{"rôle":1}': ("unknown_field: rôle", None),
    }
    rows = spark.createDataFrame([(x,) for x in given], "a string")
    found = A.validated(rows, "a", ["kind"], ["firm"], ["role"]).collect()
    assert {r.a: (r.error, r.postings) for r in found} == given


def test_lists_are_open_unless_surely_over(spark):
    rows = [("2024-01-01",), ("2024-12-31",), (None,), ("",), ("soon",), ("D-1",)]
    df = spark.createDataFrame(rows, f"{V.END} string").withColumn("on", F.lit(dt.date(2024, 6, 1)))
    rules = [U.Rule(1, V.END, "date_parse", 1, {"formats": ["%Y-%m-%d"]})]
    assert {r[V.END] for r in V.still_open(df, rules, V.END, "2024-06-01", "on").collect()} == {"2024-12-31", None, "", "soon", "D-1"}


def test_seed_and_rewrite_of_nothing(spark):
    some = spark.createDataFrame([(1, "a", 5)], "k int, v string, kept int")
    assert M.seeded(some.limit(0), some.limit(0)).count() == 0
    assert [tuple(r) for r in M.rewrite(some, some.select("k", "v").limit(0), ["k"], ["kept"]).collect()] == [(1, "a", 5)]
    new = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    assert sorted(map(tuple, M.rewrite(some, new, ["k"], ["kept"]).collect())) == [(1, None, 5), (2, "b", None)]


def test_rules_merge_once(spark):
    kinds = "id long, field_name string, rule_type string, rule_config_json string, priority int, note string"
    ours = spark.createDataFrame([(4, "title", "trim", "{}", 1, "ours")], kinds)
    theirs = spark.createDataFrame([(1, "title", "trim", "{}", 1, "same"), (2, "old", "trim", "{}", 2, "first"), (3, "firm", "trim", "{}", 2, "again"), (9, "gone", "trim", "{}", 3, "")], kinds)
    every, counts = M.merge_rules(ours, theirs, F.lit(True), {"old": "firm", "gone": None})
    assert sorted((r.id, r.field_name, r.note) for r in every.collect()) == [(4, "title", "ours"), (5, "firm", "first")]
    assert tuple(counts.first()) == (1, 3)
    again, counts = M.merge_rules(every, theirs, F.lit(True), {"old": "firm", "gone": None})
    assert again.count() == 2 and tuple(counts.first()) == (0, 4)


def test_arguments_of_calls():
    call = "goDetail('10', \"C_1\"); other(7)"
    assert [P.argument(call, i) for i in (0, 1, 2, 3)] == ["", "10", "C_1", ""]
    assert (P.argument("view( 83 , x); return false;", 1), P.argument("view()", 1), P.argument("", 1)) == ("83", "", "")


def test_links_reach_no_further_than_three_ancestors():
    root = parse("<a href='/far'><div><div><div><li class=i>x</li></div></div></div></a><a href='/near'><p class=i>y</p></a>")
    far, near = select(root, ".i")
    assert P.item_link(far, "a", "")[0] is None
    assert P.item_link(near, "a", "") == ("/near", None)
    assert P.item_link(near, "", "") == (None, "no selector") and P.item_link(near, "", "/x") == (None, "nothing to fill in")


def test_labels_of_deadlines(value):
    def read(page):
        return value(P.labelled_deadline(F.lit(page)))

    assert read("<p>접수기간: 24.10.02 ~ 24.10.15 (D-3)</p>") == "24.10.02 ~ 24.10.15"
    assert read("<div><span>마감기한</span></div><span>2026년 1월 2일(금) 오후 6시</span>") == "2026년 1월 2일(금) 오후 6시"
    assert read("<button>마감일순</button><p>접수 기간 <b>2024.1.1</b></p><dl><dt>마감일</dt><dd>2024-02-01 23:59</dd></dl>") == "2024-02-01 23:59"
    assert read("<nav><b>마감일</b><i>2024.1.1</i></nav>") == ""


def test_nothing_is_inferred_from_little(spark):
    payloads = spark.createDataFrame([("s", 0, '{"a":[{"t":"One job here","n":"12345"},{"t":"zz","n":"12345"}]}'), ("s", 1, "no json"), ("s", 2, None)], "site string, request int, body string")
    found = I.entries(payloads)
    assert found.count() == 4
    assert I.list_of_titles(found, spark.createDataFrame([("s", "One job here"), ("s", "Two")], "site string, title string")).count() == 0
    links = spark.createDataFrame([("s", 0, "https://x/12345"), ("s", 1, "https://x/123456")], "site string, place int, link string")
    assert I.id_and_template(found, links).count() == 0  # the same link for both


def test_delivered_pages():
    from sparrowline.functions.delivery import cleaned
    from sparrowline.functions.spans import located

    deep = "<div>" * 3000 + "<p>in</p>" + "</div>" * 3000
    assert cleaned(deep, "https://a.example/").count("<div>") == 3000
    assert cleaned("", "https://a.example/") is None and cleaned("<p> </p><form>x</form>", "https://a.example/") is None
    body = "<div><p>" + "word " * 30 + "</p></div>"
    assert cleaned(body + "<hr>" + body, "https://a.example/") == cleaned(body, "https://a.example/") + "<hr>"
    assert cleaned("<td></td><pre>a\n  b</pre><a href='#x'>t</a>", "https://a.example/") == "<td></td><pre>a\n  b</pre>t"
    assert cleaned("<img src='data:x'><p>a&lt;b &amp; c</p>", "https://a.example/") == "<p>a&lt;b &amp; c</p>"
    assert located("at HQ (Seoul 63 building).", "hq seoul-63 Building") == "HQ (Seoul 63 building)"
    assert located("a (must) license", "(must) license") == "(must) license" and located("abc", "x") is None and located("ab", "b") is None
