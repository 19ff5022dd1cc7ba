from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sparrowline.functions import dates as D
from sparrowline.functions import html as H
from sparrowline.functions import text as T
from sparrowline.operators import merge as M
from sparrowline.operators import predicates as P
from sparrowline.operators import relational as R
from sparrowline.operators import rules as U
from sparrowline.operators import stateful as S
from sparrowline.plans import registry
from sparrowline.sources import payloads as J
from sparrowline.streaming import runs as ST

ON = dt.date(2024, 12, 10)

LOOSE = [
    # text, start, end
    ("2024.10.31", "2024-10-31 00:00:00", "2024-10-31 23:59:59"),
    ("2024년 9월 2일(월) 23: 05 마감", "2024-09-02 23:05:00", "2024-09-02 23:05:00"),
    ("26.1.5", "2026-01-05 00:00:00", "2026-01-05 23:59:59"),
    ("1/10", "2025-01-10 00:00:00", "2025-01-10 23:59:59"),
    ("12월 25일", "2024-12-25 00:00:00", "2024-12-25 23:59:59"),
    ("6/15", "2024-06-15 00:00:00", "2024-06-15 23:59:59"),
    ("October 07, 2026(Wed)~December 31, 2026(Thu)", "2026-10-07 00:00:00", "2026-12-31 23:59:59"),
    ("2024.01.02 ~", "2024-01-02 00:00:00", "2024-01-02 23:59:59"),
    ("2024.13.40", None, None),
    ("Feb 30, 2024, 2024-03-01", "2024-03-01 00:00:00", "2024-03-01 23:59:59"),
    ("2024/2/29 오후 6시 30분", "2024-02-29 18:30:00", "2024-02-29 18:30:00"),
    ("2024/2/29 24:00", "2024-02-29 00:00:00", "2024-02-29 23:59:59"),
    ("D-32", None, "2025-01-11 23:59:59"),
    ("d - DAY", None, "2024-12-10 23:59:59"),
    ("내일 마감", None, "2024-12-11 23:59:59"),
    ("2024.10.31 (D-32)", "2024-10-31 00:00:00", "2024-10-31 23:59:59"),
    ("2026.\u00a09.\u00a020", "2026-09-20 00:00:00", "2026-09-20 23:59:59"),  # spaces beyond ASCII
    ("2026.\u30009.\u300020 23:\u300059", "2026-09-20 23:59:00", "2026-09-20 23:59:00"),
    ("2024.2.30, 24.3.1", "2024-03-01 00:00:00", "2024-03-01 23:59:59"),  # no day, so the next way of writing counts
    ("Feb 30, 2024", None, None),
    ("오늘 마감 D-3", None, "2024-12-13 23:59:59"),
    ("9/20 ~ 상시 D-1", "2024-09-20 00:00:00", "2024-09-20 23:59:59"),
    ("always", None, None),
    ("", None, None),
    (None, None, None),
]


def test_loose_dates(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(LOOSE)], "i int, t string")
    on = F.lit(ON)
    found = df.select("i", D.loose_moment(F.col("t"), on).alias("s"), D.loose_moment(F.col("t"), on, end=True).alias("e")).collect()
    for r in found:
        assert (r.i, r.s, r.e) == (r.i, *LOOSE[r.i][1:])


def test_counted_days_are_settled(spark):
    cases = {"D-32": "2025-01-11", "2024.10.31 (D-3)": "2024.10.31", "오늘 마감": "2024-12-10", "open": "open", "ID-32": "ID-32"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.s for r in df.select("t", D.without_days_left(F.col("t"), F.lit(ON)).alias("s")).collect()} == cases


def test_loose_day_is_a_function_of_sql(spark):
    D.register(spark)
    rows = spark.sql("SELECT loose_day(t, DATE '2024-12-10') AS d FROM VALUES ('1/10'), ('D-3'), (''), (NULL), ('open') AS x(t)").collect()
    assert [r.d for r in rows] == ["2025-01-10", "2024-12-13", None, None, None]


def test_formats_and_letters():
    assert D.spark_format("%Y.%m.%d %H:%M") == "yyyy.M.d H:m"
    assert D.spark_format("100%% %Yx") == "100% yyyy'x'"
    with pytest.raises(ValueError):
        D.spark_format("%j")


def row(**k):
    return {"id": 1, "field_name": "f", "priority": 1, "enabled": 1, "rule_config_json": "{}"} | k


@pytest.mark.parametrize(
    "given,reason",
    [
        ({"rule_type": "nothing"}, "type"),
        ({"rule_type": "trim", "rule_config_json": '{"other": 1}'}, "config"),
        ({"rule_type": "trim", "rule_config_json": "["}, "config"),
        ({"rule_type": "regex", "rule_config_json": '{"pattern": "("}'}, "value"),
        ({"rule_type": "regex", "rule_config_json": "{}"}, "value"),
        ({"rule_type": "date_parse", "rule_config_json": '{"formats": ["%m.%d"]}'}, "value"),
        ({"rule_type": "mapping", "rule_config_json": '{"map": 3}'}, "value"),
    ],
)
def test_rules_are_refused_with_a_reason(given, reason):
    with pytest.raises(U.RuleError) as e:
        U.read_rule(row(**given))
    assert e.value.reason == reason


def test_patterns_go_over_to_java(spark):
    rules = [U.read_rule(row(rule_type="regex", rule_config_json='{"pattern": "(?P<a>\\\\d+)-(\\\\w)", "replacement": "\\\\2$\\\\g<a>"}'))]
    df = spark.createDataFrame([("12-é", ON), (None, ON)], "f string, on date")
    assert [r.f for r in U.normalized(df, rules, ["f"], "on").collect()] == ["é$12", None]


def test_an_empty_value_stops_the_rules_and_failures_stay_apart(spark):
    rules = [
        U.read_rule(row(id=1, rule_type="mapping", rule_config_json='{"map": {"none": ""}}')),
        U.read_rule(row(id=2, rule_type="date_parse", priority=2, rule_config_json='{"formats": ["%Y-%m-%d"]}')),
    ]
    df = spark.createDataFrame([("none", ON), ("2024-02-03", ON), ("bad", ON), ("2024-02-30", ON)], "f string, on date")
    found = U.normalized(df, rules, ["f"], "on").collect()
    assert [(r.f, r.error) for r in found[:2]] == [(None, None), ("2024-02-03 00:00:00", None)]
    assert {r.error for r in found[2:]} == {"f: date_parse 2"}


def test_three_values_of_pairs_and_caps(spark):
    df = spark.createDataFrame([("A", "y"), (None, "y"), (None, "x"), ("B", "y")], "a string, b string")
    assert [r.b for r in df.filter(P.not_in_pairs(F.col("a"), F.col("b"), [("A", "y")])).collect()] == ["x", "y"]
    years = spark.createDataFrame([("",), (None,), ("3",), ("4",), ("many",)], "y string")
    assert [r[0] for r in years.select(P.years_cap(F.col("y"), 3)).collect()] == [True, True, True, False, False]


def test_feed_pages_cover_every_row_once(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i // 4)) for i in range(23)]
    df = spark.createDataFrame(rows, "id long, at timestamp_ntz")
    seen, cursor, more = [], None, True
    while more:
        page, more, cursor = R.read_feed(df, "at", "id", cursor, 5)
        seen += [r.id for r in page]
    assert seen == list(range(23))
    page, more, again = R.read_feed(df, "at", "id", cursor, 5)
    assert page == [] and not more and again == cursor
    for bad in ("", "x", cursor[:-3]):
        with pytest.raises(ValueError):
            R.decode_cursor(bad)
    assert len(R.read_feed(df, "at", "id", None, 0)[0]) == 23 and len(R.read_feed(df, "at", "id", None, -4)[0]) == 1


def test_acknowledging_twice_changes_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "before"), (3, None)], "id long, delivered_at string")
    asked = spark.createDataFrame([(1,), (2,), (9,), (1,)], "id long")
    once, outcome = R.acknowledge(df, asked, "id", "delivered_at", "now")
    assert {r.id: r.outcome for r in outcome.collect()} == {1: "marked", 2: "already", 9: "missing"}
    twice, _ = R.acknowledge(once, asked, "id", "delivered_at", "later")
    want = {1: "now", 2: "before", 3: None}
    assert {r.id: r.delivered_at for r in once.collect()} == {r.id: r.delivered_at for r in twice.collect()} == want


def test_merging_again_is_no_change(spark):
    old = spark.createDataFrame([(1, "a", 2, "e", "x")], "k long, page_hash string, attempts int, error string, last_seen string")
    new = spark.createDataFrame([(1, "b"), (2, "c")], "k long, page_hash string")
    first = M.detect_changes(old, new, "k", "now")
    assert {r.k: (r.change, r.attempts, r.error) for r in first.collect()} == {1: ("CHANGED", 0, None), 2: ("NEW", 0, None)}
    assert {r.change for r in M.detect_changes(first.drop("change"), new, "k", "later").collect()} == {"SAME"}


def test_import_keeps_ours_and_numbers_the_rest(spark):
    ours = spark.createDataFrame([(5, "a"), (7, "b")], "id long, name string")
    theirs = spark.createDataFrame([(3, "b"), (900_001, "d"), (1, "c"), (4, "c")], "id long, name string")
    rows, ids = M.import_rows(ours, theirs, ["name"], "id")
    assert {r.name: r.id for r in rows.collect()} == {"a": 5, "b": 7, "c": 8, "d": 9}
    assert {r.their_id: r.our_id for r in ids.collect()} == {3: 7, 1: 8, 4: 8, 900_001: 9}


def test_streaks_and_missed_runs(spark):
    runs = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, False, True, True])] + [(2, 9, False), (3, 1, True)], "k long, id long, failed boolean")
    assert {r.k: r.streak for r in R.streaks(runs, "k", "id", F.col("failed")).collect()} == {1: 2, 2: 0, 3: 1}
    trusted = spark.createDataFrame([(1, r) for r in (10, 20, 30, 40)], "source long, run_id long")
    postings = spark.createDataFrame([(1, "a", None), (1, "b", None), (1, "c", 30)], "source long, url string, since long")
    seen = spark.createDataFrame([(1, 10, "a"), (1, 40, "b"), (1, 35, "a")], "source long, run_id long, url string")
    found = {r.url: (r.missed_runs, r.closed) for r in S.missed_state(trusted, postings, seen).collect()}
    assert found == {"a": (3, True), "b": (0, False), "c": (2, False)}


def test_trust_needs_a_baseline(spark):
    cols = "source long, run_id long, complete boolean, scheduled boolean, status string, list_misses int, capped boolean, matched int"
    rows = [(1, i, True, True, "success", 0, False, n) for i, n in enumerate([10, 10, 10, 4, 5, 10])]
    rows += [(1, 6, True, False, "success", 0, False, 10), (1, 7, True, True, "success", 2, False, 10), (1, 8, True, True, "failed", 0, False, 10)]
    found = {r.run_id: r.reason for r in S.trust(spark.createDataFrame(rows, cols)).collect()}
    assert [found[i] for i in range(9)] == ["too few runs to compare"] * 3 + ["far fewer than usual", None, None, "not scheduled", "items unread", "not successful"]


@pytest.mark.parametrize("each", [1, 10, 1000])
def test_trust_of_a_long_source_carries_over_ranges(spark, each):
    cols = "source long, run_id long, complete boolean, scheduled boolean, status string, list_misses int, capped boolean, matched int"
    draw = random.Random(1)
    rows = [
        (draw.choice([1, 1, 2, None]), i, True, True, "failed" if draw.random() < 0.3 or 60 < i < 110 else "success", 0, False, draw.randrange(1, 30))
        for i in range(300)
    ]
    found = S.trust(spark.createDataFrame(rows, cols), each=each)
    past, want = {}, {}
    for source, i, _, _, status, _, _, n in rows:
        last = past.setdefault(source, [])[-7:]
        few = len(last) < 3
        want[i] = "not successful" if status == "failed" else "too few runs to compare" if few else "far fewer than usual" if n < 0.5 * statistics.median(last) else None
        past[source] += [n] if status == "success" else []
    assert {r.run_id: r.reason for r in found.collect()} == want


def test_trust_gate_judges_all_events(spark, tmp_path):
    rows = [(i, u, "click", 10.0) for i, u in enumerate([1, 20, 21, 500] * 5)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = registry.queries()["median_trust_gate_all"](spark, str(tmp_path)).collect()
    assert sorted(r.run_id for r in found) == list(range(20))
    assert sum(r.reason is None for r in found) == 4 * 2


def test_duplicates_of_others(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", None, 3), ("b", "x", 4), ("c", "y", 5), ("c", "y", 5)], "k string, g string, id long")
    assert sorted(r.id for r in R.duplicates_of_others(df, ["k", "g"], "id").collect()) == [1, 2]


def test_html():
    page = """<html><body><nav><ul><li><a href="/a?x=1">One</a><li class="k z"><b>Two</b> words</li></ul></nav>
      <script>if (a<b) "<p>"</script><p>First &amp; best<br>line</p><div>next<div>inner</div></div><!-- gone --><p data-x="1">last</body></html>"""
    assert H.html_text.plain("no markup < here") == "no markup < here"
    assert H.html_text.plain("<p>a &lt; b</p><p>c</p>") == "a < b\nc"
    assert H.visible_text.plain(page) == "One Two words First & best line next inner last"
    items = H.list_items.plain(page, "nav li", "a", "https://x.org/list/")
    assert [(i["index"], i["title"], i["link"]) for i in items] == [(0, "One", "https://x.org/a?x=1"), (1, "Two words", None)]
    assert H.detail_fields.plain(page, (("a", "li.z"), ("b", "p[data-x=1]"), ("c", "#none"))) == {"a": "Two words", "b": "last", "c": None}
    clean = H.sanitized.plain('<div onclick="x"><p> a<script>1</script></p><p> </p><img data-src="/i.png"><a href="javascript:x">b</a></div>', "https://x.org/")
    assert clean == '<p> a</p><img src="https://x.org/i.png"><a>b</a>'
    ld = '<script type="application/ld+json">[{"@type":["A","JobPosting"],"b":1,"a":2},{"@graph":[{"@type":"JobPosting"}]}]</script><script type="application/ld+json">{</script>'
    assert H.json_ld.plain(ld, "JobPosting") == ['{"@type": ["A", "JobPosting"], "a": 2, "b": 1}', '{"@type": "JobPosting"}']
    assert H.labelled.plain("<dl><dt>Deadline</dt><dd>2024-01-02</dd></dl><p>Place: here</p>", ("deadline",)) == "2024-01-02"
    assert H.labelled.plain("<p>Place: here</p>", ("place",)) == "here"
    icons = '<link rel="icon" sizes="64x64" href="b"><link rel="apple-touch-icon" href="c"><link rel="icon" sizes="128x128" href="d">'
    assert H.page_image.plain(icons) == "c" and H.page_image.plain(icons + '<meta property="og:image" content="e">') == "e"
    assert H.payload_text.plain('{"a": {"title": "Some work", "url": "https://x", "code": "AB_1"}, "l": ["x y", "x y"]}') == "title: Some work\nl: x y\nl: x y"


def test_columns_of_text(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("v")).first().v

    lit = F.lit
    assert value(T.fold_repeat(lit("a\nb\na\nb"))) == "a\nb" and value(T.fold_repeat(lit("a"))) == "a" and value(T.fold_repeat(lit("a\nb"))) == "a\nb"
    assert value(T.canonical_url(lit("http://x/p?a=1&id=b%31&c#f"), "^id=b1$")) == "http://x/p?a=1&c#f"
    assert value(T.canonical_url(lit("http://x/p?id=b1"), "^id=b1$")) == "http://x/p"
    assert value(T.canonical_url(lit("http://x/p?%zz=1#id=b1"), "^id=b1$")) == "http://x/p?%zz=1#id=b1"
    assert value(T.first_count(lit("00 of 1,250"))) == 1250 and value(T.first_count(lit("O명"))) is None
    assert value(T.paragraphs(lit("a<b\nc\n\n\nd&"))) == "<p>a&lt;b<br>c</p><p>d&amp;</p>"
    assert value(T.stated(lit("공고에 명시 없음."))) is None and value(T.stated(lit(" a  b "))) == "a b"
    assert value(T.company_key(lit("(주)Samp-le 전기"))) == "sample전기"
    assert value(T.without_order(lit("3차시 Backend"))) == "Backend" and value(T.without_order(lit("Backend 2"))) == "Backend 2"
    for title in ("2024 인재 풀 등록", "인재등록 안내", "2026 인재DB", "[본사] 상시 인재 Pool 등록", "인재 상시 DB 등록용", "상시등록", "Talent\u3000Pool"):
        assert value(T.is_talent_pool(lit(title))), title
    for title in (None, "", "인재 채용", "인력풀 담당자", "Pool manager"):
        assert not value(T.is_talent_pool(lit(title))), title
    items = F.array(F.struct(lit("a").alias("name"), lit("the  'quote'").alias("quote")), F.struct(lit("b").alias("name"), lit("absent").alias("quote")))
    kept, lost = T.grounded_names(items, lit("all of thequote here"))
    assert [r.name for r in value(kept)] == ["a"] and value(lost) == ["b"]
    assert value(T.same_title(lit("engineer"), lit("engineer (x)"))) and not value(T.same_title(lit("eng"), lit("eng x")))
    assert value(J.sections({"a": {"x": lit(" 1 "), "y": lit(" ")}, "b": {"z": lit(None).cast("string")}})) == {"a": {"x": "1"}}
    assert value(J.record(lit(" "), lit(None).cast("string"), lit("c"))) == "c"


def test_csv_programs(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_bytes("﻿id , name\n1,a\n2,b\n1,c\n,d\n".encode())
    good, bad = J.read_programs(spark, str(p), ["id", "name"], "id")
    assert sorted((r.id, r.name) for r in good.collect()) == [("1", "a"), ("2", "b")]
    assert sorted((r.name, r.reason) for r in bad.collect()) == [("c", "repeated"), ("d", "no key")]
    with pytest.raises(ValueError, match="missing: none"):
        J.read_programs(spark, str(p), ["id", "none"], "id")
    p.write_bytes("id,name\n1,가\n".encode("cp949"))
    assert J.read_programs(spark, str(p), ["id"], "id", ["utf-8", "cp949"])[0].first().name == "가"
    p.write_bytes("id,name\n1,가\n".encode())
    assert J.read_programs(spark, str(p), ["id"], "id", ["utf-8", "cp949"])[0].first().name == "가"
    p.write_bytes(b"id,name\n1,\xff\xff\n")
    with pytest.raises(ValueError, match="in none of"):
        J.read_programs(spark, str(p), ["id"], "id", ["utf-8", "us-ascii"])


def test_imports_are_checked(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "id long")
    assert J.checked_import(df, {"id": "bigint"}, 3, 3) is df
    for magic, most, reason in ((b"PAR1", 10, "more than 10"), (b"SQLi", 1 << 20, "another kind")):
        df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/t")
        assert J.checked_files(spark, f"{tmp_path}/t", b"PAR1") > 100
        with pytest.raises(ValueError, match=reason):
            J.checked_files(spark, f"{tmp_path}/t", magic, most)
    with pytest.raises(ValueError, match="no such file"):
        J.checked_files(spark, f"{tmp_path}/none", b"PAR1")
    for required, version in (({"id": "string"}, 1), ({"no": "string"}, 1), ({"id": "bigint"}, 4)):
        with pytest.raises(ValueError):
            J.checked_import(df, required, version, 3)


def test_streaming_state_is_the_batch_state(spark, tmp_path):
    rows = [(i % 3, i, i % 4 != 1) for i in range(40)]
    schema = "user_id long, id long, failed boolean"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.STATE_STORE)
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    spark.createDataFrame(rows[:25], schema).coalesce(1).write.parquet(f"{folder}")
    stream = ST.streaks(ST.read_folder(spark, str(folder), spark.createDataFrame([], schema).schema))
    ST_rows = []

    def keep(df, _):
        ST_rows.extend(df.collect())

    def drain():
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start().awaitTermination()

    drain()
    spark.createDataFrame(rows[25:], schema).coalesce(1).write.mode("append").parquet(f"{folder}")
    drain()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {r.user_id: r.streak for r in sorted(ST_rows, key=lambda r: r.last_id)}
    batch = R.streaks(spark.createDataFrame(rows, schema), "user_id", "id", F.col("failed"))
    assert last == {r.user_id: r.streak for r in batch.collect()}


def test_deep_pages_and_payloads_end_no_job(spark):
    page = "<div>" * 5000 + "<p>in</p><script>x</script>" + "</div>" * 5000
    payload = '{"a":' + "[" * 400 + '"in"' + "]" * 400 + "}"
    row = spark.range(1).select(
        H.sanitized(F.lit(page), "https://a.example/").alias("html"), H.visible_text(F.lit(page)).alias("text"),
        H.json_leaves(F.lit(payload)).alias("leaves"), H.json_leaves(F.lit("[" * 100_000)).alias("none"),
        H.payload_text(F.lit("[" * 100_000)).alias("said"), H.canonical_json_hash(F.lit("[" * 100_000)).alias("hash"),
        H.page_parts(F.lit(page), "https://a.example/").alias("parts"),
    ).first()
    assert (row.html, row.text, row.none, row.said, row.hash) == ("<p>in</p>", "in", [], "", None)
    assert [(x.path, x.value) for x in row.leaves] == [("a" + ".*" * 400, "in")]
    assert tuple(row.parts[k] for k in ("html", "visible", "blocks", "image")) == ("<p>in</p>", "in", "in", None)


def test_numbers_of_rows_are_places_of_a_sort(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    found = R.numbered(rows, [F.desc("x")], "n").collect()
    assert {(r.x, r.n) for r in found} == {(x, 1000 - x) for x in range(1000)}
    assert R.numbered(rows.limit(0), [F.desc("x")], "n").count() == 0


def test_numbers_inside_keys_are_places_of_a_sort(spark):
    """One key has two thirds of all rows; null is a key of its own."""
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 5}", (i * 7919) % 1000) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at int").repartition(6)
    found = R.numbered_within(df, "k", [F.desc("at")], "n").collect()
    want = {}
    for k, at in sorted(rows, key=lambda r: -r[1]):
        want.setdefault(k, []).append(at)
    assert sorted(((r.k or "", r.at, r.n) for r in found)) == sorted((k or "", at, i + 1) for k, ats in want.items() for i, at in enumerate(ats))
    assert R.numbered_within(df.limit(0), "k", [F.asc("at")], "n").columns == ["k", "at", "n"]
