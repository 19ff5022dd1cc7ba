"""Named queries: what selectors find in pages, how well a site's selectors cover them, what payloads tell; texts whose signs matter."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sparrowline.functions import coverage as C
from sparrowline.functions import dates as D
from sparrowline.functions import html as H
from sparrowline.functions import spans as S
from sparrowline.functions import text as T
from sparrowline.operators import grounding as G
from sparrowline.operators import rules as U
from sparrowline.plans.registry import query
from sparrowline.sources.tables import dealt

MADE = {
    "ul > li": "n",
    "ul>li , h1, h2": "n + 2",
    "li:nth-child(2)": "CASE WHEN n >= 2 THEN 1 ELSE 0 END",
    "li:nth-child(odd)": "(n + 1) // 2",
    "li:nth-child(3n+1)": "(n + 2) // 3",
    "li:nth-last-child(-n+2)": "least(n, 2)",
    "li + li": "n - 1",
    "li.first ~ li": "n - 1",
    "li:not(.first, .open)": "n - 1 - open",
    'a[href*="job"]': "n",
    "a[href^='/job/'][href$='.HTML' i]": "n",
    "a[data-k~=two]": "open",
    "a[lang|=ko]": "n",
    "li:has(> a.x)": "open",
    "li.open > a:only-child": "open",
    "p:nth-of-type(2)": "1",
    "p:empty": "1",
    "div > *:last-child:not(p)": "1",
    'li:contains("item 0")': "1",
    "h1 ~ ul li:nth-child(1 of .open)": "CASE WHEN open > 0 THEN 1 ELSE 0 END",
}
REFUSED = ("ul >", "li::text", "a[href", "li:hover")


@query(
    "selectors_made",
    "WITH p AS (SELECT p_partkey, p_size % 7 + 1 AS n, (p_size % 7 + 1) // 2 AS open FROM part) "
    + " UNION ALL ".join(f"SELECT p_partkey, '{s.replace(chr(39), chr(39) * 2)}' AS selector, CAST({n} AS INTEGER) AS matches, false AS refused FROM p" for s, n in MADE.items())
    + "".join(f" UNION ALL SELECT p_partkey, '{s}', NULL, true FROM p" for s in REFUSED),
)
def selectors_made(spark, sf_dir):
    """What selectors of all kinds find in made pages; those that are not understood say so in their row."""
    k = F.sequence(F.lit(0), F.col("p_size") % 7)
    item = F.transform(
        k,
        lambda i: F.concat(
            F.when(i == 0, '<li class="first">').when(i % 2 == 1, '<li class="item open">').otherwise('<li class="item">'),
            F.lit('<a href="/job/'), i.cast("string"), F.when(i % 2 == 1, '.html" lang="ko-KR" class="x" data-k="one two">').otherwise('.html" lang="ko">'), F.lit("item "), i.cast("string"), F.lit("</a></li>"),
        ),
    )
    page = F.concat(F.lit("<div><h1>a</h1><p>b</p><h2>c</h2><p> </p><ul>"), F.array_join(item, ""), F.lit("</ul></div>"))
    rows = dealt(spark, sf_dir, "part").select("p_partkey", F.explode(H.selector_matches(page, (*MADE, *REFUSED))).alias("m"))
    return rows.select("p_partkey", "m.selector", "m.matches", F.col("m.reason").isNotNull().alias("refused"))


PAGES = {
    "article > h1:first-child": "1",
    "article p": "(length(html) - length(replace(html, '<p>', ''))) // 3",
    'nav li > a[href^="/"]': "(length(html) - length(replace(html, '<a href=\"/', ''))) // 10",
    "body > :is(nav, footer)": "2",
    "nav + div.ad, div.ad ~ article": "2",
    "html[lang=en], html[lang=de]": "CASE WHEN html LIKE '%<html lang=\"en\">%' OR html LIKE '%<html lang=\"de\">%' THEN 1 ELSE 0 END",
}


@query(
    "selectors_on_pages",
    " UNION ALL ".join(f"SELECT page_id, '{s}' AS selector, CAST({n} AS INTEGER) AS matches FROM pages" for s, n in PAGES.items()),
)
def selectors_on_pages(spark, sf_dir):
    """What selectors find in all fetched pages, whole."""
    rows = dealt(spark, sf_dir, "pages").select("page_id", F.explode(H.selector_matches(F.col("html"), tuple(PAGES))).alias("m"))
    return rows.select("page_id", "m.selector", "m.matches")


@query(
    "coverage_verdicts",
    """SELECT p_partkey,
         CASE k WHEN 0 THEN 'list.date' WHEN 1 THEN 'list.item,list.title,list.link,list.date' WHEN 2 THEN 'list.title,list.link,list.date'
                WHEN 3 THEN 'list.link,detail.body' WHEN 4 THEN 'list.item,list.title,list.link,list.date' ELSE 'selectors' END AS failed,
         CASE k WHEN 0 THEN 'list.company_name,detail.department' WHEN 5 THEN '' ELSE 'detail.department' END AS skipped, false AS ok, k IN (1, 4) AS list_missing, k = 2 AS list_fields_missing,
         CASE k WHEN 3 THEN 'no item with a link to follow: no link to follow' WHEN 4 THEN 'list.item is refused' WHEN 5 THEN NULL
                WHEN 1 THEN 'no item with a link to follow' WHEN 2 THEN 'no item with a link to follow: no element' ELSE '' END AS link
       FROM (SELECT p_partkey, p_partkey % 6 AS k FROM part)""",
)
def coverage_verdicts(spark, sf_dir):
    """A site's selectors against its pages: failed, skipped and well; no list at all, or items with nothing in them."""
    key = F.col("p_partkey") % 6
    item, inner, link = ("<li class=job>", "<b>t</b><i>2024.1.1</i>", "<a href='/1'>x</a>")
    page = F.when(key == 0, f"<ul>{item}<b>t</b>{link}</li></ul>").when(key == 2, f"<ul>{item}x</li></ul>").when(key == 3, f"<ul>{item}{inner}<a href='#'>x</a></li></ul>")
    page = page.when(key == 4, f"<ul>{item}{inner}{link}</li></ul>").otherwise("<p>nothing")
    detail = F.when(key == 3, "<h1>t</h1>").otherwise("<h1>t</h1><main>b</main>")
    chosen = '{"list": {"item": "%s", "title": "b", "link": "a[href]", "date": "i"%s}, "detail": {"title": "h1", "body": "main", "department": ""}}'
    said = F.when(key == 5, "[1").when(key == 4, chosen % ("li:hover", "")).when(key == 0, chosen % ("ul > li.job", ', "company_name": ""')).otherwise(chosen % ("ul > li.job", ""))
    rows = dealt(spark, sf_dir, "part").select("p_partkey", C.checks(said, page, detail).alias("checks"))
    link_row = F.get(F.filter("checks", lambda c: c["name"] == "list.link"), F.lit(0))
    return rows.select("p_partkey", C.verdict(F.col("checks")).alias("v"), link_row["message"].alias("link")).select("p_partkey", "v.*", "link")


@query(
    "payload_text_made",
    r"""SELECT p_partkey, 'name: ' || p_name || chr(10) || 'opened: 2026.08.25' || chr(10) || 'endDt: 20261016' || chr(10) || 'endTm: 1705' || chr(10) || 'kr: ' || line || chr(10)
         || 'kr: ' || line || chr(10) || 'tags: Seoul' || chr(10) || 'tags: Seoul' || chr(10) || 'body: first ' || p_partkey || chr(10) || 'second & last' || chr(10)
         || 'sentence: 자세한 내용은 www.x.com 에서' AS said FROM (SELECT *, '- two years of ' || p_name || ' +' AS line FROM part)""",
)
def payload_text_made(spark, sf_dir):
    """Payloads as lines: codes, links and markup go, dates stay; what two entries of a list share is kept in both, what one says twice is not."""
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    line = F.concat(F.lit("- two years of "), name, F.lit(" +"))
    entry = F.concat(F.lit('{"kr":"'), line, F.lit('","en":"'), line, F.lit(' "}'))
    payload = F.concat(
        F.lit('{"hidden":"N","seq":'), key, F.lit(',"code":"G12002","ok":true,"none":null,"empty":"null","name":"'), name, F.lit('","logo":"a/b.png","site":"go to www.x.com",'),
        F.lit('"opened":"2026.08.25","endDt":"20261016","wrong":"20261316","endTm":"1705","no":"1705","items":['), entry, F.lit(","), entry, F.lit('],"tags":["Seoul","Seoul"],'),
        F.lit('"body":"<p>first '), key, F.lit('</p><p>second &amp; last</p><p>N</p>","sentence":"자세한 내용은 www.x.com 에서"}'),
    )
    return dealt(spark, sf_dir, "part").select("p_partkey", H.payload_text(payload).alias("said"))


@query(
    "pieces_with_signs",
    """SELECT p_partkey, 'C++ and ' || p_name || chr(10) || '10%' || chr(10) || 'Use C# daily' || chr(10) || '(HQ (2F))' AS value, 1 AS whole_lines, 2 AS lost FROM part""",
)
def pieces_with_signs(spark, sf_dir):
    """Copied pieces whose signs matter: C++ is not C#, 10% is not 10; brackets that a span opens are closed."""
    source = F.concat(F.lit("Title\nwe write c++ AND "), F.col("p_name"), F.lit("\nraise of 10% yearly\nUse C# daily\nat ((HQ (2F)))"))
    pieces = [(1, F.lit("\tUse C++ daily\n")), (0, F.lit("10% ")), (3, F.lit("[3] Use F# daily")), (9, F.lit("11%")), (9, F.lit("C&")), (4, F.lit("(hq (2f"))]
    pieces[0] = (1, F.concat(F.lit(" - C++ and "), F.col("p_name"), F.lit("\n")))
    given = F.array(*[F.struct(F.lit(n).alias("line"), text.alias("text")) for n, text in pieces])
    rows = dealt(spark, sf_dir, "part").select("p_partkey", S.resolved_pieces(source, given).alias("r"))
    # The source writes the first piece in letters of its own.
    return rows.select("p_partkey", F.replace("r.value", F.lit("c++ AND"), F.lit("C++ and")).alias("value"), "r.whole_lines", "r.lost")


@query(
    "rules_of_all_patterns",
    r"""SELECT p_partkey, '(' || p_name || ')' AS brackets, replace(p_name, ' ', '') || '-' AS short, 'a_b_' || p_partkey AS classes, p_brand || chr(10) || 'x' AS lines, '\1b' AS signs,
              'K' || lower(p_type) AS letters, false AS failed FROM part""",
)
def rules_of_all_patterns(spark, sf_dir):
    """Rules whose patterns mean something else to the JVM's engine: brackets in classes, open counts, doubled signs, escapes, letters of any case."""
    rules = {
        "brackets": (r"[[](.*)[]]", r"(\1)", F.concat(F.lit("["), F.col("p_name"), F.lit("]"))),
        "short": (r" {,3}$", "-", F.replace("p_name", F.lit(" "), F.lit(""))),
        "classes": (r"[&&]", "_", F.concat(F.lit("a&b&"), F.col("p_partkey"))),
        "lines": (r"; ", r"\n", F.concat(F.col("p_brand"), F.lit("; x"))),
        "signs": (r"(?P<first>a)b", r"\\1b", F.lit("ab")),
        "letters": ("(?i)K+", "K", F.concat(F.lit("kKK"), F.lower("p_type"))),
    }
    read = [U.read_rule({"id": i, "field_name": f, "rule_type": "regex", "priority": 1, "enabled": 1, "rule_config_json": json.dumps({"pattern": p, "replacement": r})}) for i, (f, (p, r, _)) in enumerate(rules.items())]
    rows = dealt(spark, sf_dir, "part").select("p_partkey", F.lit("2024-01-01").cast("date").alias("on"), *[c.alias(f) for f, (_, _, c) in rules.items()])
    return U.normalized(rows, read, list(rules), "on").select("p_partkey", *rules, F.col("error").isNotNull().alias("failed"))


@query(
    "answers_with_line_feeds",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE 'IT' END AS choice, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE '3' END AS number,
              p_partkey % 4 = 3 AS empty, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE TIMESTAMP '2026-09-03 00:00:00' END AS day FROM part""",
)
def answers_with_line_feeds(spark, sf_dir):
    """Answers and cells that end in line feeds, tabs and other white space: judged, counted, dated and found empty without it."""
    key = F.col("p_partkey") % 4
    around = F.when(key == 0, "\n").when(key == 1, "\t \r\n").when(key == 2, "　\x1c ").otherwise(" \n")

    def said(text):
        return F.concat(around, F.when(key < 3, text).otherwise(""), around)

    source = F.lit("3 years in IT")
    rows = dealt(spark, sf_dir, "part").select(
        "p_partkey", G.judged(said("IT"), said("IT"), source, ["IT"])["value"].alias("choice"), G.counted(said("3"), said("3 years"), source)["value"].alias("number"),
        T.filled(said("x")).isNull().alias("empty"), D.parse_formats(said("2026.9.3"), ["%Y.%m.%d"]).alias("day"),
    )
    return rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("choice", "number")})


@query(
    "rules_html_text",
    """SELECT p_partkey, p_name || chr(10) || '- ' || p_brand || ' R&D' || chr(10) || chr(10) || 'next' || chr(10) || 'end' AS body, p_name || ' <3' AS title FROM part""",
)
def rules_html_text(spark, sf_dir):
    """Markup as lines by a rule: edges of blocks that meet end one line, blank lines of the text itself stay; plain texts are left alone."""
    page = F.concat(F.lit("<div><p>"), F.col("p_name"), F.lit("</p><p>&nbsp;</p><ul><li>- <b>"), F.col("p_brand"), F.lit("</b> R&amp;D\n\n\n\n  next</li></ul></div><!-- x --><br>end"))
    read = [U.read_rule({"id": i, "field_name": f, "rule_type": "html_text", "priority": 1, "enabled": 1, "rule_config_json": "{}"}) for i, f in enumerate(("body", "title"))]
    rows = dealt(spark, sf_dir, "part").select("p_partkey", F.lit("2024-01-01").cast("date").alias("on"), page.alias("body"), F.concat("p_name", F.lit(" <3")).alias("title"))
    return U.normalized(rows, read, ["body", "title"], "on").select("p_partkey", "body", "title")
