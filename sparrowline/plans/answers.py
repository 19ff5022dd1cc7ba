"""Named queries: answers and what bears them out, reasons for a look, state written again, and what pages say."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowline.functions import delivery as D
from sparrowline.functions import html as H
from sparrowline.functions import pages as P
from sparrowline.functions import spans as S
from sparrowline.operators import answers as A
from sparrowline.operators import grounding as G
from sparrowline.operators import inference as I
from sparrowline.operators import merge as M
from sparrowline.operators import review as V
from sparrowline.plans.registry import query
from sparrowline.plans.states import rule
from sparrowline.sources import outbound as O
from sparrowline.sources.tables import dealt, table

TREE = {"north": ["n1", "n2"], "south": ["s1", "other south"]}


def _choice(key, *values):
    """One of some values in turn, by a whole number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


@query(
    "field_grounding",
    """SELECT o_orderkey, CASE WHEN k5 = 1 THEN '' ELSE o_clerk END AS clerk, CASE WHEN k4 IN (0, 1) THEN o_orderpriority ELSE '' END AS priority,
              CASE WHEN k3 = 0 THEN '7' ELSE '' END AS years, CASE WHEN k5 = 0 THEN 'Jobs@Firm.example' ELSE '' END AS mail,
              concat_ws(', ', CASE WHEN k5 = 1 THEN 'clerk: not in source' END, CASE WHEN k4 = 2 THEN 'priority: not in list' END,
                        CASE k3 WHEN 1 THEN 'years: not a number' WHEN 2 THEN 'years: no evidence' END,
                        CASE k5 WHEN 1 THEN 'mail: not in source' WHEN 2 THEN 'mail: not an email' END) AS dropped,
              CASE WHEN k4 = 0 THEN o_orderpriority END AS quote
       FROM (SELECT *, 'Clerk#' || o_custkey AS o_clerk, o_orderkey % 3 AS k3, o_orderkey % 4 AS k4, o_orderkey % 5 AS k5 FROM orders)""",
)
def field_grounding(spark, sf_dir):
    """Fields of an answer that the posting bears out, and why others were dropped: every reason for single fields."""
    k = F.col("o_orderkey")
    clerk = F.concat(F.lit("Clerk#"), F.col("o_custkey"))
    body = F.concat(clerk, F.lit("\nPriority: "), "o_orderpriority", F.lit("\n7 years or more. jobs@FIRM.example"))
    given = {
        "clerk": G.extracted(F.when(k % 5 == 1, "no such clerk").otherwise(F.concat(clerk, F.lit("\n"), clerk)), body),
        "priority": G.judged(F.when(k % 4 == 2, "9-NONE").when(k % 4 == 3, " ").otherwise(F.col("o_orderpriority")), F.when(k % 4 == 0, F.col("o_orderpriority")).otherwise("never said"), body,
                             ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]),
        "years": G.counted(_choice(k, "07", "seven", "7"), F.when(k % 3 == 2, "9 years").otherwise("7 years"), body),
        "mail": G.addressed(_choice(k, "write to Jobs@Firm.example!", "jobs@elsewhere.example", "nobody", "", ""), body),
    }
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in given.items()], F.array_join(G.dropped(given), ", ").alias("dropped"))
    return rows.select("o_orderkey", *[F.col(f"{n}.value").alias(n) for n in given], "dropped", F.col("priority.evidence").alias("quote"))


@query(
    "region_and_role_grounding",
    """SELECT p_partkey, CASE WHEN k3 < 2 THEN CASE k3 WHEN 0 THEN 'north' ELSE 'south' END ELSE '' END AS region,
              CASE WHEN k4 = 0 AND k3 = 0 THEN 'n1' WHEN k4 = 1 AND k3 = 1 THEN 's1' ELSE '' END AS inner_region,
              CASE WHEN k4 = 2 THEN 'not in list' WHEN k4 = 3 THEN NULL WHEN k4 = 0 AND k3 <> 0 THEN 'outside' WHEN k4 = 1 AND k3 <> 1 THEN 'outside' END AS why,
              CASE k3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'other' END AS field,
              CASE WHEN k4 = 3 THEN '' WHEN k4 = 0 AND k3 = 0 THEN 'n1' WHEN k4 = 1 AND k3 = 1 THEN 's1' WHEN k4 = 2 THEN CASE WHEN k3 = 1 THEN 'other south' ELSE 'other' END
                   WHEN k3 = 2 THEN '' WHEN k3 = 1 THEN 'other south' ELSE 'other' END AS role
       FROM (SELECT p_partkey, p_partkey % 3 AS k3, p_partkey % 4 AS k4 FROM part)""",
)
def region_and_role_grounding(spark, sf_dir):
    """A smaller region inside a larger one, a role inside its field; what does not fit is dropped or becomes `other`."""
    k = F.col("p_partkey")
    outer, inner = _choice(k, "north", "south", "west"), _choice(k, "n1", "s1", "w1", "")
    said = F.lit("no quote")
    region, part = G.placed(outer, inner, said, F.col("p_name"), TREE)
    field, role = G.field_and_role(outer, inner, (said, said), F.col("p_name"), TREE, "other")
    rows = table(spark, sf_dir, "part").select("p_partkey", region.alias("a"), part.alias("b"), field.alias("c"), role.alias("d"))
    return rows.select("p_partkey", F.col("a.value").alias("region"), F.col("b.value").alias("inner_region"), F.col("b.reason").alias("why"),
                       F.col("c.value").alias("field"), F.col("d.value").alias("role"))


def _answers(spark, sf_dir):
    k = F.col("event_id")
    n = k.cast("string")
    text = _choice(
        k % 8,
        '{"kind":"x","common":{"firm":"F"},"postings":[{"role":"r#"},{"role":"","years":3}]}',
        '{"kind":"x","common":{"firm":"F","role":"moved#"},"postings":[{"years":"1"},{"role":"own"}]}',
        '{"role":"top#","common":{"firm":"F"}}',
        '{"kind":"x","common":{"firm":"F","other":1},"zzz":2,"postings":[{"who":"x"}]}',
        "no answer #",
        '{"kind":"x","common":[1],"postings":[]}',
        '{"kind":true,"kind_evidence":"said","common":"","postings":""}',
        '{"kind":"x","postings":[1,2]}',
    )
    return table(spark, sf_dir, "events").select("event_id", F.replace(text, F.lit("#"), n).alias("answer"))


@query(
    "answer_errors",
    """SELECT event_id, CASE event_id % 8 WHEN 3 THEN 'unknown_field: zzz, common.other, postings[0].who' WHEN 4 THEN 'unparsable' WHEN 5 THEN 'unparsable' WHEN 7 THEN 'unparsable' END AS error,
              CASE WHEN event_id % 8 IN (0, 1) THEN 'x' WHEN event_id % 8 = 6 THEN 'true' END AS kind FROM events""",
)
def answer_errors(spark, sf_dir):
    """Answers that are no JSON object, or have parts of the wrong kind or names that nobody knows."""
    rows = A.validated(_answers(spark, sf_dir), "answer", ["kind"], ["firm"], ["role", "years"])
    return rows.select("event_id", "error", F.try_element_at("top", F.lit("kind")).alias("kind"))


@query(
    "answer_postings",
    """SELECT event_id, CAST(unnest([0, 1]) AS INTEGER) AS place, CASE event_id % 8 WHEN 0 THEN unnest(['r' || event_id, NULL]) ELSE unnest(['moved' || event_id, 'own']) END AS role,
              CASE event_id % 8 WHEN 0 THEN unnest([NULL, '3']) ELSE unnest(['1', NULL]) END AS years, 'F' AS firm FROM events WHERE event_id % 8 < 2
       UNION ALL SELECT event_id, 0, 'top' || event_id, NULL, 'F' FROM events WHERE event_id % 8 = 2""",
)
def answer_postings(spark, sf_dir):
    """The postings of sound answers; a field that stands among the common or top ones goes to postings without it."""
    rows = A.validated(_answers(spark, sf_dir), "answer", ["kind"], ["firm"], ["role", "years"])
    each = rows.select("event_id", "common", F.posexplode("postings").alias("place", "p"))
    return each.select("event_id", "place", *[F.try_element_at("p", F.lit(n)).alias(n) for n in ("role", "years")], F.try_element_at("common", F.lit("firm")).alias("firm"))


@query(
    "deadline_day_differs",
    """SELECT o_orderkey AS raw_job_id FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0""",
)
def deadline_day_differs(spark, sf_dir):
    """Postings whose stored deadline is another day than the suggested one, but for those that a person set."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    base = orders.select(key.alias("raw_job_id"), F.lit(1).alias("part"), "o_orderdate")
    postings = base.withColumn(V.END, F.date_format("o_orderdate", "yyyy-MM-dd 23:59:00"))
    k = F.col("raw_job_id")
    said = F.when(k % 7 == 0, "soon").otherwise(F.date_format(F.date_add("o_orderdate", F.when(k % 3 == 0, 0).otherwise(2)), "yyyy. M. d '오후 11:59'"))
    suggestions = base.filter(k % 2 == 0).select("raw_job_id", "part", F.lit(V.END).alias("field_name"), said.alias("value"))
    overrides = base.filter(k % 5 == 0).select("raw_job_id", "part", F.lit(V.END).alias("field_name"))
    return V.differing_deadlines(postings, suggestions, overrides, F.lit("2024-01-01").cast("date")).select("raw_job_id")


def _posting(key):
    """A posting's fields, each empty for the multiples of a number of its own."""
    fields = {name: F.when(key % (i + 3) == 0, _choice(key, "", "  ")).otherwise("x") for i, name in enumerate(V.AUTO_FIELDS)}
    fields |= {"parent_company_name": F.when(key % 2 == 0, "p"), "recruitment_type": F.when(key % 13 == 0, None).when(key % 4 == 0, "ALWAYS_OPEN").otherwise("PERIOD")}
    flags = {"delivery_failed": 5, "classified": 7, "thin_content": 2, "career_cap": 3, "deadline_diff": 11}
    flags = {name: key % n == (1 if name == "classified" else 0) for name, n in flags.items()}
    return fields | flags | {"classified": ~flags["classified"], "body": F.repeat(F.lit("b"), (key % 400).cast("int")), "education_level": F.when(key % 11 != 0, "x")}


def _empty_sql(i):
    return f"k % {i + 3} = 0"


_EMPTY = {name: _empty_sql(i) for i, name in enumerate(V.AUTO_FIELDS)} | {
    "company_name": "(k % 3 = 0 AND k % 2 <> 0)", "recruitment_type": "k % 13 = 0", "education_level": "k % 11 = 0",
    "recruitment_end_at": "(k % 16 = 0 AND NOT (k % 13 <> 0 AND k % 4 = 0))",
}


@query(
    "auto_missing_fields",
    "SELECT p_partkey, concat_ws(',', " + ", ".join(f"CASE WHEN {_EMPTY[n]} THEN '{n}' END" for n in V.AUTO_FIELDS) + ") AS missing FROM (SELECT p_partkey, p_partkey AS k FROM part)",
)
def auto_missing_fields(spark, sf_dir):
    """All fields that keep a posting from going out by itself, the two with special cases among them."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(V.auto_missing(_posting(F.col("p_partkey"))), ",").alias("missing"))


@query(
    "all_reasons",
    """SELECT p_partkey, concat_ws(',', CASE WHEN k % 5 = 0 THEN 'delivery_failed' END, CASE WHEN k % 7 = 1 THEN 'unclassified' END,
         CASE WHEN c AND k % 3 = 0 AND k % 2 <> 0 THEN 'no_company' END, CASE WHEN c AND k % 4 = 0 THEN 'no_title' END, CASE WHEN c AND k % 7 = 0 THEN 'no_job_role' END,
         CASE WHEN c AND k % 16 = 0 THEN 'no_deadline' END, CASE WHEN c AND k % 9 = 0 THEN 'no_employment_type' END, CASE WHEN c AND k % 10 = 0 THEN 'no_experience_type' END,
         CASE WHEN c AND k % 11 = 0 THEN 'no_education_level' END, CASE WHEN c AND k % 13 = 0 THEN 'no_recruitment_type' END, CASE WHEN c AND k % 2 = 0 THEN 'thin_content' END,
         CASE WHEN c AND k % 3 = 0 THEN 'career_cap' END, CASE WHEN k % 400 < 200 THEN 'short_body' END, CASE WHEN k % 11 = 0 THEN 'deadline_diff' END) AS reasons
       FROM (SELECT p_partkey, p_partkey AS k, p_partkey % 7 <> 1 AS c FROM part)""",
)
def all_reasons(spark, sf_dir):
    """The fourteen reasons for a look at a posting."""
    found = V.reasons(_posting(F.col("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", *[F.when(c, name) for name, c in found.items()]).alias("reasons"))


@query(
    "list_closed_exclusion",
    "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3 = 0 AND CAST(o_orderdate AS DATE) < DATE '1997-01-01')",
)
def list_closed_exclusion(spark, sf_dir):
    """Items of a list whose deadline is over; emptied and unreadable ones are open."""
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy.MM.dd")).when(k == 1, "always").otherwise("1990-13-45")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias(V.END), F.lit("1997-01-01").cast("date").alias("on"))
    rules = [rule(1, V.END, "mapping", 1, {"map": {"always": ""}}), rule(2, V.END, "date_parse", 2, {"formats": ["%Y.%m.%d"]})]
    return V.still_open(rows, rules, V.END, "1997-01-01", "on").select("o_orderkey")


@query(
    "seed_if_empty",
    "SELECT 'full' AS kind, n_nationkey AS id FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'empty', n_nationkey FROM nation",
)
def seed_if_empty(spark, sf_dir):
    """A seed goes into a table without rows, and not into one with rows."""
    nations = table(spark, sf_dir, "nation")
    full = M.seeded(nations.filter("n_regionkey = 0"), nations).select(F.lit("full").alias("kind"), F.col("n_nationkey").alias("id"))
    return full.union(M.seeded(nations.filter("n_regionkey < 0"), nations).select(F.lit("empty"), "n_nationkey"))


@query(
    "rewrite_in_place",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 10 END AS delivered_at
       FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0""",
)
def rewrite_in_place(spark, sf_dir):
    """Rows normalized again keep what was delivered; new ones have nothing delivered; untouched ones stay."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    old = orders.filter(k % 2 == 0).select("o_orderkey", F.lit("old").alias("title"), (k * 10).alias("delivered_at"))
    new = orders.filter(k % 3 != 0).select("o_orderkey", F.col("o_orderpriority").alias("title"))
    return M.rewrite(old, new, ["o_orderkey"], ["delivered_at"])


@query(
    "rule_merge",
    """WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'title' ELSE 'firm' END AS f, '{"n":' || (c_custkey % 40) || '}' AS c, c_nationkey AS p FROM customer),
       k AS (SELECT f, c, p, min(id) AS id FROM t WHERE f IS NOT NULL AND p <> 3 GROUP BY f, c, p HAVING NOT (f = 'firm' AND p < 10)),
       mine AS (SELECT DISTINCT c, p FROM t WHERE p < 10),
       last AS (SELECT count(*) AS n FROM mine)
       SELECT f AS field_name, c AS rule_config_json, p AS priority, n + row_number() OVER (ORDER BY id) AS id FROM k, last""",
)
def rule_merge(spark, sf_dir):
    """Another system's rules that ours does not have, numbered on; renamed, dropped and unreadable fields."""
    customers, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    config = F.concat(F.lit('{"n":'), k % 40, F.lit("}"))
    field = F.when(k % 5 == 0, "gone").when(k % 5 == 1, "title").when(k % 2 == 0, "company").otherwise("firm")
    theirs = customers.select(k.alias("id"), field.alias("field_name"), F.lit("regex").alias("rule_type"), config.alias("rule_config_json"), F.col("c_nationkey").alias("priority"))
    ours = theirs.filter("priority < 10").select(F.lit("firm").alias("field_name"), "rule_type", "rule_config_json", "priority").distinct()
    ours = M.numbered(ours.withColumn("id", F.col("priority") * 1000 + F.get_json_object("rule_config_json", "$.n").cast("long")), [F.asc("id"), F.asc("rule_config_json")], "_n")
    ours = ours.select(F.col("_n").alias("id"), "field_name", "rule_type", "rule_config_json", "priority")
    every, _ = M.merge_rules(ours, theirs, F.col("priority") != 3, {"company": "firm", "gone": None})
    return every.join(ours.select("id"), "id", "left_anti").select("field_name", "rule_config_json", "priority", "id")


@query(
    "rename_inside_parent",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'first' ELSE o_orderpriority END AS role FROM orders",
)
def rename_inside_parent(spark, sf_dir):
    """A name changed in the facts, only under its own parent."""
    names = spark.createDataFrame([("F", "1-URGENT", "first"), ("X", "2-HIGH", "second")], "parent string, old string, new string")
    facts = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("role"), F.col("o_orderstatus").alias("field"))
    return M.renamed_inside(facts, names, "role", "field").select("o_orderkey", "role")


def _page(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


@query(
    "page_texts_made",
    """SELECT p_partkey, p_name || ' ' || p_brand || ' & more x' AS visible, p_name || chr(10) || chr(10) || p_brand || ' & more' || chr(10) || chr(10) || 'x' AS blocks,
              '<h1>' || p_name || '</h1><p><b>' || p_brand || '</b> &amp; more<br></p><a href="https://a.example/p/' || p_partkey || '">x</a>' AS html,
              'https://a.example/' || p_partkey || '.png' AS image FROM part""",
)
def page_texts_made(spark, sf_dir):
    """What pages made of the table's rows show: all text, lines, HTML of known tags, and their image, of one parse."""
    page = _page(
        "<html><head><title>t</title><style>p{}</style><meta property='og:image' content='https://a.example/", F.col("p_partkey"), ".png'></head><body><h1 class=a>", F.col("p_name"),
        "</h1><script>no()</script><p style='x'><b>", F.col("p_brand"), "</b> &amp; more<br></p><div></div><a href='/p/", F.col("p_partkey"), "' onclick='y'>x</a></body></html>",
    )
    rows = dealt(spark, sf_dir, "part").select("p_partkey", H.page_parts(page, "https://a.example/list/").alias("p"))
    # The title is no part of the body, but of the page's lines and HTML.
    return rows.select("p_partkey", F.col("p")["visible"].alias("visible"), F.regexp_replace(F.col("p")["blocks"], r"^t\s*", "").alias("blocks"),
                       F.regexp_replace(F.col("p")["html"], "^t", "").alias("html"), F.col("p")["image"].alias("image"))


@query(
    "page_lists_made",
    """SELECT p_partkey, CAST(unnest([0, 1]) AS INTEGER) AS index, unnest([p_name, 'no link']) AS title, unnest(['https://a.example/list/' || p_partkey || '?a=1&b=2', NULL]) AS link FROM part""",
)
def page_lists_made(spark, sf_dir):
    """Items of lists in pages made of the table's rows."""
    page = _page("<ul id=l><li><a href='", F.col("p_partkey"), "?a=1&amp;b=2'> ", F.col("p_name"), " </a></li><li><b>no link</b></ul><ul><li>other</ul>")
    items = H.list_items(page, "#l li", "a", "https://a.example/list/")
    return dealt(spark, sf_dir, "part").select("p_partkey", F.explode(items).alias("i")).select("p_partkey", "i.*")


@query(
    "page_fields_made",
    """SELECT p_partkey, p_name AS title, p_brand || chr(10) || chr(10) || p_type AS body, CAST(NULL AS VARCHAR) AS gone, 'until 2024' AS labelled,
              '[{"@type": "JobPosting", "id": ' || p_partkey || '}]' AS found,
              sha256('{"a": ' || p_partkey || ', "b": "' || p_brand || '"}') AS hash, 'https://a.example/x/' || p_partkey AS joined,
              'title: ' || p_name AS said FROM part""",
)
def page_fields_made(spark, sf_dir):
    """Fields by selector and by label, structured data, canonical JSON, joined links and texts of payloads made of the table's rows."""
    key, name = F.col("p_partkey"), F.col("p_name")
    page = _page("<h2>", name, "</h2><div class=b><p>", F.col("p_brand"), "</p><p>", F.col("p_type"), "</p></div><p>Deadline: until 2024</p>",
                 '<script type="application/ld+json">{"@graph":[{"id":', key, ',"@type":"JobPosting"},{"@type":"Thing"}]}</script>')
    found = H.detail_fields(page, (("title", "h2"), ("body", "div.b"), ("gone", "section")))
    payload = _page('{"title": "', name, '", "url": "https://a.example", "code": "A_1", "again": null}')
    unordered = _page('{"b":"', F.col("p_brand"), '",  "a":', key, "}")
    rows = dealt(spark, sf_dir, "part").select(
        "p_partkey", found.alias("f"), H.labelled(page, ("deadline",)).alias("labelled"), F.concat(F.lit("["), F.array_join(H.json_ld(page, "JobPosting"), ","), F.lit("]")).alias("found"),
        H.canonical_json_hash(unordered).alias("hash"), H.joined_url(F.lit("https://a.example/list/1"), _page("../x/", key)).alias("joined"), H.payload_text(payload).alias("said"),
    )
    return rows.select("p_partkey", *[F.try_element_at("f", F.lit(n)).alias(n) for n in ("title", "body", "gone")], "labelled", "found", "hash", "joined", "said")


@query(
    "page_source_text",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Firm' || chr(10) || chr(10) || p_name WHEN 1 THEN p_name || chr(10) || chr(10) || 'Where' || chr(10) || chr(10) || p_brand ELSE '' END AS text,
              CASE p_partkey % 3 WHEN 0 THEN '2024.10.31' ELSE '' END AS deadline, CASE p_partkey % 3 WHEN 1 THEN p_type END AS kind FROM part""",
)
def page_source_text(spark, sf_dir):
    """A posting's whole text around its bodies, a copy of a body left out; what is labelled beside them."""
    key, name = F.col("p_partkey") % 3, F.col("p_name")
    one = _page("<body><nav>menu</nav><div><h3>Firm</h3><div class=body>", name, "</div><footer>foot</footer></div><div class=body>", name, "</div><dl><dt>서류 접수 마감일 :</dt><dd>2024.10.31 (D-3)</dd></dl></body>")
    one = F.replace(one, F.lit("<div class=body>"), F.lit("<div class='body x'>"))
    two = _page("<main><p class=body>", name, "</p><p>Where</p><p class=body>", F.col("p_brand"), "</p><aside>other</aside></main><div><span>Kind</span></div><div>", F.col("p_type"), "</div>")
    page = F.when(key == 0, one).when(key == 1, two).otherwise("<p>nothing</p>")
    info = P.labelled_info(page, ("Kind", "Where"), "")
    return dealt(spark, sf_dir, "part").select("p_partkey", P.source_text(page, ".body").alias("text"), P.labelled_deadline(page).alias("deadline"),
                                               F.try_element_at(info, F.lit("Kind")).alias("kind"))


@query(
    "link_resolution",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '/jobs/' || p_partkey WHEN 1 THEN '/around/' || p_partkey WHEN 2 THEN NULL WHEN 3 THEN '/v?no=' || p_partkey || '&k=a%20b' ELSE NULL END AS link,
              CASE p_partkey % 6 WHEN 2 THEN 'no link to follow' WHEN 4 THEN 'no element' WHEN 5 THEN 'no href' END AS reason FROM part""",
)
def link_resolution(spark, sf_dir):
    """Links of items: inside, around, by attribute template and call arguments; and why others have none."""
    key = F.col("p_partkey")
    page = F.when(key % 6 == 0, _page("<li class=i><a href=' /jobs/", key, "'>x</a></li>"))
    page = page.when(key % 6 == 1, _page("<a href='/around/", key, "'><div><p class=i>x</p></div></a>")).when(key % 6 == 2, F.lit("<li class=i><a href='javascript:go()'>x</a></li>"))
    page = page.when(key % 6 == 4, F.lit("<li class=i>x</li>")).otherwise(F.lit("<li class=i><a>x</a></li>"))
    plain = P.item_links(page, ".i", "a")
    call = _page("<li class=i onclick=\"show('", key, "', 'a b')\">x</li>")
    made = P.item_links(call, ".i", "", "/v?no={onclick|arg1}&k={onclick|arg2}")
    rows = dealt(spark, sf_dir, "part").select("p_partkey", F.get(F.when(key % 6 == 3, made).otherwise(plain), F.lit(0)).alias("i"))
    return rows.select("p_partkey", "i.link", "i.reason")


@query(
    "fragment_list",
    """SELECT p_partkey, CAST(unnest([0, 1, 2]) AS INTEGER) AS index, unnest([p_partkey || 'a', NULL, p_partkey || 'c']) AS id, unnest([p_name, 'second', NULL]) AS title,
              unnest(['https://a.example/v/' || p_partkey || 'a', NULL, NULL]) AS link, unnest([NULL, 'id', 'title']) AS failed FROM part""",
)
def fragment_list(spark, sf_dir):
    """Items of lists that come as pieces of HTML, and what some of them lack."""
    key = F.col("p_partkey")
    piece = _page("<li><b>", F.col("p_name"), "</b><i data-id='", key, "a'></i></li><li><b>second</b></li><li><i data-id='", key, "c'></i></li>")
    items = P.fragment_items(piece, "li", "b", "i@data-id", "https://a.example/v/{id}")
    return dealt(spark, sf_dir, "part").select("p_partkey", F.explode(items).alias("i")).select("p_partkey", "i.*")


@query(
    "item_id_candidates",
    """SELECT p_partkey, CAST(unnest([0, 1, 2]) AS INTEGER) AS place, unnest(['path', 'query', 'attribute']) AS kind, unnest(['last', 'no', 'data-v']) AS detail,
              unnest(['p' || (1000 + p_partkey), 'q' || (1000 + p_partkey), '1,' || (1000 + p_partkey)]) AS value FROM part
       UNION ALL SELECT p_partkey, 3, 'digits', 'data-v', '1' || (1000 + p_partkey) FROM part UNION ALL SELECT p_partkey, 4, 'digits', 'data-y', '' || (1000 + p_partkey) FROM part""",
)
def item_id_candidates(spark, sf_dir):
    """What may be an item's id, likeliest first."""
    n = (F.col("p_partkey") + 1000).cast("string")
    piece = _page("<li data-v='1,", n, "' data-x='none'><a href='https://a.example/x/p", n, "/?no=q", n, "&e='>x</a><b data-y='p", n, "'></b></li>")
    found = P.id_candidates(piece)
    return dealt(spark, sf_dir, "part").select("p_partkey", F.posexplode(found).alias("place", "c")).select("p_partkey", "place", "c.*")


@query(
    "list_inference",
    """SELECT n_nationkey AS site, 'data.jobs' AS path, CAST(3 AS INTEGER) AS size, CAST(3 AS BIGINT) AS hits, 'no' AS key, 'https://a.example/v/{id}?x=1' AS template FROM nation""",
)
def list_inference(spark, sf_dir):
    """Which list of each site's payloads holds its postings, and how their links are made."""
    k = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation")
    jobs = F.concat_ws(",", *[_page('{"name":"Job ', F.col("n_name"), f' {c}","no":"77', k, f'{i}","sort":"10{i}"}}') for i, c in enumerate("abc")])
    body = _page('{"menu":[{"t":"Job ', F.col("n_name"), ' a"},{"t":"zz"}],"data":{"jobs":[', jobs, '],"tags":["x","y"]}}')
    found = I.entries(nations.select(k.alias("site"), F.lit(0).alias("request"), body.alias("body")))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("c")) for i, c in enumerate("abc")])).alias("e")
    rows = nations.select(k.alias("site"), "n_name", each).select("site", "n_name", "e.*")
    titles = rows.select("site", _page("Job  ", F.col("n_name"), " ", F.col("c")).alias("title"))
    links = rows.select("site", "place", _page("https://a.example/v/77", F.col("site"), F.col("place"), "?x=1").alias("link"))
    best = I.list_of_titles(found, titles)
    own = found.join(best.select("site", "request", "path"), ["site", "request", "path"], "left_semi")
    return best.join(I.id_and_template(own, links), "site").select("site", "path", "size", "hits", "key", "template")


@query(
    "delivery_html_made",
    """SELECT p_partkey, CASE WHEN p_partkey % 9 = 8 THEN NULL ELSE '<div><h2>' || p_name || '</h2><p>one<br>two</p><img src="https://a.example/i/' || p_partkey || '.png" alt="a"> plain <a href="mailto:a@b.example">m</a></div>'
              || '<div>' || repeat(p_type, 20) || '</div>' END AS html FROM part""",
)
def delivery_html_made(spark, sf_dir):
    """Pages made of the table's rows as they go out: lazy images, line breaks, no scripts, empty blocks, unsafe links and repeats."""
    key, long = F.col("p_partkey"), F.repeat(F.col("p_type"), 20)
    page = _page(
        "<section class=x>\n <h2>", F.col("p_name"), "</h2> <p style='white-space: pre-line'>\none\ntwo\n</p><p> <span> </span></p><img src='data:x' data-original='/i/", key,
        ".png' alt='a'> <font>plain</font>\n\u200b<a href='mailto:a@b.example'>m</a><a href='javascript:x()'></a></section><script>x</script><!-- c -->",
        "<div>", long, "</div><footer>f</footer><div>", long, "</div>",
    )
    page = F.when(key % 9 == 8, "<div> <p>&nbsp;</p><script>x</script></div>").otherwise(page)
    return dealt(spark, sf_dir, "part").select("p_partkey", D.delivery_html(page, "https://a.example/list").alias("html"))


@query(
    "piece_resolution",
    """SELECT p_partkey, '(' || p_name || ')' || chr(10) || p_brand || chr(10) || 'last line, whole' AS value, CAST(1 AS INTEGER) AS whole_lines, CAST(1 AS INTEGER) AS lost FROM part""",
)
def piece_resolution(spark, sf_dir):
    """Copied pieces as the source has them: in their own line, in another one, as a whole line, or lost; each once."""
    source = _page("First (", F.col("p_name"), ").\n", F.col("p_brand"), " and more\nlast line, whole")
    pieces = [(F.lit(0), F.upper(_page("( ", F.col("p_name"), ")"))), (F.lit(0), F.col("p_brand")), (F.lit(1), F.col("p_brand")), (F.lit(2), F.lit("qqq zzz")), (F.lit(9), F.lit("xxjj")), (F.lit(0), F.lit("--"))]
    given = F.array(*[F.struct(n.alias("line"), text.alias("text")) for n, text in pieces])
    return dealt(spark, sf_dir, "part").select("p_partkey", S.resolved_pieces(source, given).alias("r")).select("p_partkey", "r.*")


@query(
    "outbound_fields",
    """SELECT p_partkey, CASE WHEN k % 2 = 0 THEN p_name ELSE p_brand END AS company, CASE WHEN k % 2 = 0 THEN p_brand END AS parent, CASE k % 3 WHEN 0 THEN 'DEV' END AS field, CASE k % 3 WHEN 0 THEN 'DEV_WEB' END AS role,
              CASE k % 4 WHEN 0 THEN 'PERIOD' WHEN 1 THEN 'ALWAYS_OPEN' END AS kind, CASE WHEN k % 4 <> 1 THEN '2024-01-02T23:59:59' END AS ends,
              CASE WHEN k % 5 = 0 THEN 'n1' END AS sub_region, CASE WHEN p_size >= 1 THEN CAST(p_size AS INTEGER) END AS years, 33 AS names
       FROM (SELECT *, p_partkey AS k FROM part)""",
)
def outbound_fields(spark, sf_dir):
    """All fields that go out, checked: company or parent, the contract's names of roles, choices, regions inside regions, no end of what is always open."""
    k = F.col("p_partkey")
    columns = {c for group in (O.TEXTS, O.CHOICES, O.COUNTS, O.MOMENTS, O.FLAGS) for c in group.values()}
    c = {name: F.lit(" ") for name in columns} | {
        "company_name": F.when(k % 2 == 0, F.col("p_name")), "parent_company_name": F.col("p_brand"),
        "job_field": F.lit("development"), "job_role": _choice(k, "web", "other", ""), "recruitment_type": _choice(k, "PERIOD", "ALWAYS_OPEN", "former", " "),
        "recruitment_end_at": F.lit("2024-01-02 23:59:59"), "region": F.lit("north"), "sub_region": _choice(k, "n1", "s1", "", "n9", "x"), "experience_min_years": F.col("p_size").cast("string"),
    }
    allowed = {column: ["north", "south"] if column == "region" else ["PERIOD", "ALWAYS_OPEN"] for column in O.CHOICES.values()}
    body = O.payload(c, allowed, TREE, {("development", "web"): ("DEV", "DEV_WEB")})
    names = {"company": "companyName", "parent": "parentCompanyName", "field": "jobField", "role": "jobRole", "kind": "recruitmentType", "ends": "recruitmentEndAt", "sub_region": "subRegion"}
    rows = table(spark, sf_dir, "part").select("p_partkey", body.alias("b"))
    return rows.select("p_partkey", *[F.get_json_object("b", f"$.{v}").alias(n) for n, v in names.items()],
                       F.get_json_object("b", "$.experienceMinYears").cast("int").alias("years"), F.size(F.json_object_keys("b")).alias("names"))


@query(
    "import_linked_entities",
    """WITH pt AS (SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey % 2 = 0), po AS (SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey % 3 = 0),
       ids AS (SELECT t.id AS their_id, coalesce(o.id, (SELECT max(id) FROM po) + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY t.id)) AS our_id FROM pt t LEFT JOIN po o USING (c_name)),
       co AS (SELECT o_custkey AS parent_id, o_clerk, o_orderkey FROM (SELECT *, o_orderstatus || o_orderkey AS o_clerk FROM orders) WHERE o_custkey % 3 = 0 AND o_orderkey % 5 = 0),
       ct AS (SELECT our_id AS parent_id, o_clerk, o_orderkey FROM (SELECT *, o_orderstatus || o_orderkey AS o_clerk FROM orders) JOIN ids ON their_id = o_custkey WHERE o_orderkey % 4 = 0)
       SELECT parent_id, o_clerk AS name, sha256(parent_id || chr(31) || o_clerk) AS hash FROM (SELECT parent_id, o_clerk FROM co UNION SELECT parent_id, o_clerk FROM ct)""",
)
def import_linked_entities(spark, sf_dir):
    """Another database's parents and their children: found by natural key or added, the children under our parents' ids, their hashes computed again."""
    parents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    name = F.concat("o_orderstatus", "o_orderkey")
    children = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id"), name.alias("name"))
    hashed = children.withColumn("hash", M.content_hash([F.col(c).cast("string") for c in ("parent_id", "name")]))
    ours = parents.filter("id % 3 = 0"), hashed.filter("parent_id % 3 = 0 AND id % 5 = 0")
    theirs = parents.filter("id % 2 = 0"), hashed.filter("parent_id % 2 = 0 AND id % 4 = 0").withColumn("hash", F.lit("of their id"))
    _, rows, _ = M.import_linked(ours, theirs, (["c_name"], ["name"]), "id", "parent_id", {"hash": ["parent_id", "name"]})
    return rows.select("parent_id", "name", "hash")


@query(
    "paths_by_value",
    """SELECT 'no' AS field, 'k' AS path, count(*) AS hits FROM events UNION ALL SELECT 'on', 'l.*.on', count(*) FROM events""",
)
def paths_by_value(spark, sf_dir):
    """Which paths of the payloads hold known values, some compared by day, with enough items behind them."""
    events = dealt(spark, sf_dir, "events").select(F.col("event_id").alias("item"), F.get_json_object("props", "$.k").alias("k"), "ts")
    body = _page('{"k": "', F.col("k"), '", "l": [{"on": "', F.date_format("ts", "yyyy.MM.dd HH:mm"), '"}], "again": {"k": "x', F.col("k"), '"}}')
    leaves = events.select("item", F.explode(H.json_leaves(body)).alias("e")).select("item", "e.*")
    wanted = {"no": F.col("k"), "on": F.date_format("ts", "yyyy-MM-dd"), "never": F.lit("qqzz")}
    asked = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in wanted.items()])
    return I.paths_by_value(leaves, events.select("item", F.explode(asked).alias("a")).select("item", "a.*"), ["on"])


@query(
    "paths_by_name",
    "SELECT * FROM (VALUES ('title', 'data.jobName'), ('body', 'data.text.bodyHtml'), ('end', 'data.endDate')) t(field, path)",
)
def paths_by_name(spark, sf_dir):
    """Which paths of the payloads look like a posting's fields, by their names."""
    body = _page('{"data": {"jobName": "', F.col("p_name"), '", "jobNameEn": "x", "endDate": "2024", "text": {"bodyHtml": "', F.repeat(F.col("p_type"), 30), '"}, "body": "short"}, "name": {"a": 1}}')
    leaves = dealt(spark, sf_dir, "part").select(F.explode(H.json_leaves(body)).alias("e")).select("e.*")
    return I.paths_by_name(leaves, {"title": ["title", "name"], "body": ["body", "text"], "end": ["close", "end"], "none": ["zzz"]}, {"body": 50})


@query(
    "item_selector_narrowed",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'li.job' WHEN 1 THEN 'div.open' ELSE 'li' END AS item FROM part""",
)
def item_selector_narrowed(spark, sf_dir):
    """Selectors of list items that hold one title each: kept, narrowed, or left as they are where nothing fits."""
    k = F.col("p_partkey") % 3
    jobs = "".join(f'<li class="job"><b class="t">{n}</b></li>' for n in "abc")
    cards = "".join(f'<div class="card{n} open"><b class="t">{n}</b><p>x</p></div>' for n in "ab")
    page = F.when(k == 0, f"<ul><li>menu</li>{jobs}</ul>").when(k == 1, f'<div class="list">{cards}<div>ad</div></div>').otherwise('<li><b class="t">1</b><b class="t">2</b></li>')
    item = P.repeating_item(F.concat(page, F.lit("<i>"), F.col("p_name"), F.lit("</i>")), "li", ".t")
    return dealt(spark, sf_dir, "part").select("p_partkey", item.alias("item"))


@query(
    "page_reduced",
    "SELECT p_partkey, '<ul id=\"l\"><li class=\"j\">' || p_name || '</li><li class=\"j\">b</li></ul><p>end</p>' AS html FROM part".replace("\\", ""),
)
def page_reduced(spark, sf_dir):
    """A page's structure without scripts, with the first two of its list's items."""
    page = _page("<style>x</style><ul id=l style='y'><li class=j>", F.col("p_name"), "</li><li class=j>b</li><li class=j>c</li><li class=j>d</li></ul><script>z</script><p>end</p>")
    return dealt(spark, sf_dir, "part").select("p_partkey", P.reduced(page, 2).alias("html"))


@query(
    "scalar_lookup",
    """SELECT o_orderkey, (SELECT c.c_name FROM customer c WHERE c.c_custkey = o.o_custkey) AS name, (SELECT max(l.l_quantity) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS most FROM orders o""",
)
def scalar_lookup(spark, sf_dir):
    """One value of another table for each row: joined on its key, or on a key that was made unique first."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    most = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("most"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(names, "o_custkey", "left").join(most, "o_orderkey", "left").select("o_orderkey", "name", "most")


@query(
    "posting_details",
    """SELECT p_partkey, p_name AS title, CASE k WHEN 0 THEN p_type WHEN 1 THEN p_name || chr(10) || chr(10) || repeat(p_type || ' ', 60) || 'end' ELSE '' END AS body,
              CASE k WHEN 0 THEN '2024.01.02' WHEN 1 THEN '2024.10.31' ELSE 'soon' END AS ends, CASE k WHEN 2 THEN 'body' ELSE '' END AS unread
       FROM (SELECT *, p_partkey % 3 AS k FROM part)""",
)
def posting_details(spark, sf_dir):
    """Fields of detail pages by selector; a deadline by its label and a body near the title where selectors miss; what cannot be read."""
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    good = _page("<div><h1>", name, "</h1><p class=b>", F.col("p_type"), "</p></div><i class=e>2024.01.02</i>")
    missed = _page("<main><h1>", name, "</h1><p>", F.repeat(F.concat("p_type", F.lit(" ")), 60), "end</p><nav>menu</nav></main><i class=e>2024.09.01 ~</i><dl><dt>지원 마감일</dt><dd>2024.10.31</dd></dl>")
    none = _page("<main><h1>", name, "</h1><p>short</p></main><i class=e>soon</i>")
    page = F.when(k == 0, good).when(k == 1, missed).otherwise(none)
    found = P.posting_detail(page, (("title", "h1"), ("body", ".b"), ("recruitment_end_at", ".e")))
    rows = dealt(spark, sf_dir, "part").select("p_partkey", found.alias("f"))
    return rows.select("p_partkey", *[F.col("f")[v].alias(n) for n, v in {"title": "title", "body": "body", "ends": "recruitment_end_at", "unread": "_unread"}.items()])


@query(
    "posting_list_failures",
    """SELECT p_partkey, CAST(unnest([0, 1, 2]) AS INTEGER) AS index, unnest([p_name, 'no link', '']) AS title, unnest(['https://a.example/v/' || p_partkey, NULL, 'https://a.example/list/x']) AS link,
              unnest([p_brand, '', '']) AS company, unnest([NULL, 'link', 'title']) AS failed FROM part""",
)
def posting_list_failures(spark, sf_dir):
    """Items of list pages, those that cannot be read with the reason beside the others."""
    page = _page("<li><a href='/v/", F.col("p_partkey"), "'><b>", F.col("p_name"), "</b></a><i>", F.col("p_brand"), "</i></li><li><b>no link</b><a href='#x'>y</a></li><li><a href='x'>z</a></li>")
    items = P.posting_items(page, "li", "b", "a", "", "i", "https://a.example/list/")
    return dealt(spark, sf_dir, "part").select("p_partkey", F.explode(items).alias("i")).select("p_partkey", "i.index", "i.title", "i.link", "i.company", "i.failed")
