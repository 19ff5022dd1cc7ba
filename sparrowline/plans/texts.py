"""Named queries: identity, comparison, dates, JSON, URLs and HTML of postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowline.functions import dates as D
from sparrowline.functions import html as H
from sparrowline.functions import spans as S
from sparrowline.functions import text as T
from sparrowline.plans.registry import query
from sparrowline.sources import payloads as J
from sparrowline.sources.tables import dealt, table


@query(
    "content_hash",
    r"""SELECT doc_id, sha256(coalesce(source, '') || chr(31) || coalesce(lang, '') || chr(31)
          || trim(regexp_replace(coalesce(text, ''), '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))
          || chr(31)) AS content_hash FROM documents""",
)
def content_hash(spark, sf_dir):
    """The identity of a posting's content, white space squeezed and null as empty."""
    docs = table(spark, sf_dir, "documents")
    parts = [F.col("source"), F.col("lang"), F.col("text"), F.lit(None).cast("string")]
    return docs.select("doc_id", T.content_hash(parts).alias("content_hash"))


@query(
    "url_canonical",
    r"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '[?&](utm_source|ref)=[^&#]*') THEN url ELSE
          regexp_replace(regexp_replace(regexp_replace(url, '([?&])(utm_source|ref)=[^&#]*', '\1', 'g'), '\?&+', '?'), '[?&]+(#|$)', '\1') END AS url
        FROM pages""",
)
def url_canonical(spark, sf_dir):
    """Urls without query pieces that only tell where the reader came from."""
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url"), r"^(utm_source|ref)=").alias("url"))


@query("url_no_fragment", "SELECT page_id, split_part(url, '#', 1) AS url FROM pages")
def url_no_fragment(spark, sf_dir):
    """The address to ask for: without what names a part."""
    return table(spark, sf_dir, "pages").select("page_id", T.without_fragment(F.col("url")).alias("url"))


NOISE_SQL = r"""[\s·•◦○●□■▪▶▷–—\-*_.,;:!?()\[\]{}<>"''`~/\\|]+"""


@query("loose_text", rf"SELECT doc_id, lower(regexp_replace(text, '{NOISE_SQL}', '', 'g')) AS loose FROM documents")
def loose_text(spark, sf_dir):
    """Texts as comparisons see them."""
    return table(spark, sf_dir, "documents").select("doc_id", T.loose(F.col("text")).alias("loose"))


@query(
    "grounding_missing_lines",
    rf"""WITH p AS (SELECT b.item_id, b.text AS value, d.text AS body FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
        SELECT item_id, len(list_filter(string_split(value, chr(10)), lambda l: length(lower(regexp_replace(l, '{NOISE_SQL}', '', 'g'))) >= 2
          AND NOT contains(lower(regexp_replace(body, '{NOISE_SQL}', '', 'g')), lower(regexp_replace(l, '{NOISE_SQL}', '', 'g'))))) AS missing FROM p""",
)
def grounding_missing_lines(spark, sf_dir):
    """How many lines of a value the posting does not hold."""
    values = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value"))
    bodies = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("body"))
    found = T.missing_lines(F.col("value"), F.col("body"))
    return values.join(bodies, "item_id").select("item_id", F.size(found).cast("long").alias("missing"))


@query(
    "repeat_fold",
    """WITH t AS (SELECT doc_id, text || chr(10) || CASE WHEN doc_id % 3 = 0 THEN text ELSE 'x' END AS v FROM documents),
            p AS (SELECT *, string_split(v, chr(10)) AS s FROM t), h AS (SELECT *, len(s) // 2 AS half FROM p)
       SELECT doc_id, md5(CASE WHEN len(s) % 2 = 0 AND s[1:half] = s[half + 1:] THEN array_to_string(s[1:half], chr(10)) ELSE v END) AS folded FROM h""",
)
def repeat_fold(spark, sf_dir):
    """A value that says everything twice, said once."""
    docs = table(spark, sf_dir, "documents")
    twice = F.concat("text", F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.lit("x")))
    return docs.select("doc_id", F.md5(T.fold_repeat(twice)).alias("folded"))


@query(
    "range_pack",
    """WITH n AS (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g
                  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10))
       SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last FROM n GROUP BY l_orderkey, g""",
)
def range_pack(spark, sf_dir):
    """Line numbers packed into ranges: numbers less their place are equal inside a range."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select("l_orderkey", "l_linenumber").distinct()
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    ranges = rows.withColumn("g", F.col("l_linenumber") - place).groupBy("l_orderkey", "g")
    return ranges.agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last")).drop("g")


@query(
    "range_unpack",
    """SELECT o_orderkey, CAST(unnest(generate_series(1, 1 + o_orderkey % 4) || generate_series(9, 9 + o_orderkey % 2)) AS BIGINT) AS line FROM orders""",
)
def range_unpack(spark, sf_dir):
    """Packed ranges back to line numbers."""
    key = F.col("o_orderkey")
    ranges = F.array(F.array(F.lit(1).cast("long"), 1 + key % 4), F.array(F.lit(9).cast("long"), 9 + key % 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(T.numbers_of(ranges)).alias("line"))


@query(
    "title_shown",
    """WITH p AS (SELECT p.page_id, lower(regexp_replace(p.html, '\\s+', '', 'g')) AS hay, n.n_name AS title FROM pages p JOIN nation n ON n.n_nationkey = p.page_id % 25),
       w AS (SELECT *, list_filter(regexp_split_to_array(title, '[\\s\\[\\]()<>{}/|·,:\\-]+'), lambda x: length(x) >= 2) AS words FROM p)
       SELECT page_id, (contains(hay, lower(regexp_replace(title, '\\s+', '', 'g'))) OR (len(words) > 0 AND
         len(list_filter(words, lambda x: contains(hay, lower(x)))) >= len(words) * 0.6)) AS shown FROM w""".replace("\\\\", "\\"),
)
def title_shown(spark, sf_dir):
    """Whether a page shows a title, whole or most of its words."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("title"))
    pages = table(spark, sf_dir, "pages").withColumn("k", F.col("page_id") % 25).join(names, "k")
    return pages.select("page_id", T.shows_title(F.col("html"), F.col("title")).alias("shown"))


@query(
    "fuzzy_title",
    """SELECT p_partkey, (a = b OR (length(a) >= 6 AND contains(b, a) AND length(a) * 2 >= length(b))) AS same
       FROM (SELECT p_partkey, p_name AS a, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' (' || p_type || ')' END AS b FROM part)""",
)
def fuzzy_title(spark, sf_dir):
    """Titles that mean the same: equal, or one well inside the other."""
    other = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")))
    return table(spark, sf_dir, "part").select("p_partkey", T.same_title(F.col("p_name"), other).alias("same"))


@query(
    "text_clip",
    r"""SELECT doc_id, left(trim(regexp_replace(text, '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), 80) AS clipped
        FROM documents""",
)
def text_clip(spark, sf_dir):
    """Text in one line, cut to a length (the feature)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.clip(F.col("text"), 80).alias("clipped"))


@query(
    "allow_list_tags",
    """SELECT c_custkey, list_filter([CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END, 'EXTRA'], lambda x: x IN ('HOUSING', 'MACHINERY')) AS kept,
              list_filter([CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END, 'EXTRA'], lambda x: x NOT IN ('HOUSING', 'MACHINERY')) AS dropped FROM customer""",
)
def allow_list_tags(spark, sf_dir):
    """Tags of a list only, former names renamed, the others reported."""
    names = F.array(F.concat(F.lit(" "), "c_mktsegment"), F.lit("EXTRA"), F.col("c_mktsegment"))
    names = F.array_distinct(F.transform(names, lambda n: F.trim(n)))
    kept, dropped = T.allow_list(names, ["MACHINERY", "HOUSING"], 5, {"BUILDING": "HOUSING"})
    tags = table(spark, sf_dir, "customer").select("c_custkey", kept.alias("kept"), dropped.alias("dropped"))
    return tags.withColumn("dropped", F.array_distinct("dropped"))


@query(
    "payload_values",
    """SELECT p_partkey, p_size AS headcount, CASE p_brand WHEN 'Brand#11' THEN p_brand WHEN 'Brand#12' THEN p_brand END AS choice,
              CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, '2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') || 'T08:00:00' AS starts FROM part""",
)
def payload_values(spark, sf_dir):
    """Outward values: a number from 1, a known choice, a flag, a moment; anything else is null."""
    key = F.col("p_partkey")
    flag = F.when(key % 3 == 0, "true").when(key % 3 == 1, " false").otherwise("maybe")
    moment = F.concat(F.lit("2024-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0"), F.lit(" 08:00:00"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        T.as_count(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("headcount"),
        T.as_choice(F.col("p_brand"), ["Brand#11", "Brand#12"]).alias("choice"),
        T.as_flag(flag).alias("flag"),
        T.as_moment(moment).alias("starts"),
    )


@query(
    "typed_values",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END WHEN 1 THEN replace(printf('%,d', o_custkey), ',', '')
              WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END AS value FROM orders""".replace("printf('%,d', o_custkey)", "CAST(o_custkey AS VARCHAR)"),
)
def typed_values(spark, sf_dir):
    """Custom fields cleaned by their kind."""
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "choice").when(k == 1, "number").when(k == 2, "date").otherwise("text")
    value = (
        F.when(k == 0, F.col("o_orderstatus")).when(k == 1, F.format_number("o_custkey", 0))
        .when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", T.typed(value, kind, F.array(F.lit("F"), F.lit("O"))).alias("value"))


@query("json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_path(spark, sf_dir):
    """Values of a payload by path."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.get_json_object("props", "$.none").alias("none")
    )


@query(
    "json_list_items",
    """SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title
       FROM orders""",
)
def json_list_items(spark, sf_dir):
    """Items of a JSON list payload with their place and fields."""
    item = F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderpriority").alias("t")).alias("about"))
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(item)).alias("list"))
    payload = F.to_json(F.struct(F.struct("list").alias("data")))
    found = J.list_items(lists.select("o_custkey", payload.alias("p")), "p", "$.data.list", {"id": "$.id", "title": "$.about.t"})
    return found.select("o_custkey", "place", "id", "title")


@query(
    "json_list_outcomes",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'items' WHEN 1 THEN 'empty' WHEN 2 THEN 'not_a_list' ELSE 'missing' END AS outcome FROM events""",
)
def json_list_outcomes(spark, sf_dir):
    """What is found at a list's path: items, nothing, something else, or no path."""
    k = F.col("event_id") % 4
    payload = F.when(k == 0, F.lit('{"a":{"b":[1]}}')).when(k == 1, F.lit('{"a":{"b":[]}}')).when(k == 2, F.lit('{"a":{"b":{"c":1}}}')).otherwise(F.lit('{"a":1}'))
    return table(spark, sf_dir, "events").select("event_id", J.list_outcome(payload, "$.a.b").alias("outcome"))


@query("json_multi_texts", "SELECT n_nationkey, n_name || chr(10) || chr(10) || 'x' AS texts FROM nation")
def json_multi_texts(spark, sf_dir):
    """Texts of several paths with wildcards, each once."""
    payload = F.to_json(F.struct(F.col("n_name").alias("a"), F.array(F.struct(F.lit("x").alias("t")), F.struct(F.col("n_name").alias("t")), F.struct(F.lit("x").alias("t"))).alias("b")))
    return table(spark, sf_dir, "nation").select("n_nationkey", J.joined_texts(payload, ["$.a", "$.b[*].t", "$.none"]).alias("texts"))


@query(
    "composite_id",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'a=' || o_custkey || '&b=' || o_orderstatus END AS entry_id FROM orders",
)
def composite_id(spark, sf_dir):
    """An id of several values, only if all are there."""
    parts = {"a": F.col("o_custkey").cast("string"), "b": F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).otherwise(F.lit(" "))}
    return table(spark, sf_dir, "orders").select("o_orderkey", J.entry_id(parts).alias("entry_id"))


@query(
    "paged_list_cut",
    """WITH i AS (SELECT event_id, user_id, (event_id // 200) % 20 AS page, value < 15 AS known FROM events),
       p AS (SELECT user_id, page, bool_and(known) AS k, bool_and(page >= 12) AS l FROM i GROUP BY ALL),
       s AS (SELECT user_id, min(CASE WHEN k THEN page - 1 WHEN l THEN page END) AS stop FROM p GROUP BY 1)
       SELECT event_id FROM i JOIN s USING (user_id) WHERE page <= least(coalesce(stop, 14), 14)""",
)
def paged_list_cut(spark, sf_dir):
    """A paged list up to where reading would have stopped."""
    items = table(spark, sf_dir, "events").withColumn("page", F.floor(F.col("event_id") / 200) % 20)
    return J.cut_pages(items, "user_id", "page", F.col("value") < 15, F.col("page") < 12, 15).select("event_id")


@query(
    "paged_list_places",
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4, o_orderkey) - 1 AS place FROM orders""",
)
def paged_list_places(spark, sf_dir):
    """Items of paged lists with their places over all pages, whatever the pages' sizes."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4).alias("page"))
    pages = orders.groupBy("o_custkey", "page").agg(F.sort_array(F.collect_list("o_orderkey")).alias("items"))  # a page as it comes
    items = pages.select("o_custkey", "page", F.posexplode("items").alias("index", "o_orderkey"))
    return J.rebased(items, "o_custkey", "page", "index").select("o_orderkey", "place")


@query(
    "first_wins_skips",
    """SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN 'kept' ELSE 'repeated' END AS outcome FROM orders""",
)
def first_wins_skips(spark, sf_dir):
    """The first row of each key, and the others with the reason."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_custkey").cast("string").alias("key"))
    kept, skipped = J.first_wins(rows, "key", "o_orderkey")
    return kept.select("o_custkey", "o_orderkey", F.lit("kept").alias("outcome")).union(skipped.select("o_custkey", "o_orderkey", "reason"))


@query(
    "date_parse_multi",
    f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN o_orderdate ELSE date_trunc('day', o_orderdate) + INTERVAL '23:59:59' HOUR TO SECOND END AS ends FROM orders""".replace(
        "INTERVAL '23:59:59' HOUR TO SECOND", "INTERVAL 86399 SECOND"
    ),
)
def date_parse_multi(spark, sf_dir):
    """The first of several formats that fits; a day alone gets the end of the day."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.date_format(d, "yyyy.M.d")).when(k == 1, F.date_format(d, "MMMM dd, yyyy"))
        .when(k == 2, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    )
    moment = D.parse_formats(text, ["%Y-%m-%d %H:%M:%S", "%Y.%m.%d", "%B %d, %Y"], "23:59:59")
    return table(spark, sf_dir, "orders").select("o_orderkey", moment.alias("ends"))


@query(
    "period_split",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a' || o_orderkey || ' ' WHEN 1 THEN 'own' ELSE 'b' || o_orderkey || ' ' END AS starts,
              CASE o_orderkey % 3 WHEN 0 THEN 'a' || o_orderkey || ' ~ z' WHEN 1 THEN 'a ~ z' ELSE '' END AS ends FROM orders""",
)
def period_split(spark, sf_dir):
    """A period in the end field gives the start; an open period is a start alone."""
    k, key = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    start = F.when(k == 1, "own")
    end = F.when(k == 0, F.concat(F.lit("a"), key, F.lit(" ~ z"))).when(k == 1, "a ~ z").otherwise(F.concat(F.lit("b"), key, F.lit(" ~ ")))
    starts, ends = D.period_split(start, end)
    return table(spark, sf_dir, "orders").select("o_orderkey", starts.alias("starts"), ends.alias("ends"))


@query(
    "countdown_dates",
    """SELECT o_orderkey, strftime(o_orderdate + to_days(CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey % 100 AS INTEGER) WHEN 1 THEN 0 ELSE 1 END), '%Y-%m-%d') AS day,
              strftime(o_orderdate + to_days(CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey % 100 AS INTEGER) WHEN 1 THEN 0 ELSE 1 END), '%Y-%m-%d') || ' 23:59:59' AS moment FROM orders""",
)
def countdown_dates(spark, sf_dir):
    """Days left, counted from the day of collection."""
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit("(D-"), (F.col("o_custkey") % 100).cast("string"), F.lit(")"))).when(k == 1, "D - day").otherwise("내일 마감")
    on = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", D.without_days_left(text, on).alias("day"), D.loose_moment(text, on, end=True).alias("moment")
    )


@query(
    "loose_dates",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN CASE WHEN day(o_orderdate) > 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 18:30:00' END
          ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 23:59:59' END AS moment FROM orders""",
)
def loose_dates(spark, sf_dir):
    """Dates found in free text: English, with year, with short year, with a time of day, after the start of a period."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("until "), F.date_format(d, "MMM d, yyyy"), F.lit(" (Wed)")))
        .when(k == 1, F.concat(F.lit("2020.1.1 ~ "), F.date_format(d, "yyyy. M. d")))
        .when(k == 2, F.concat(F.date_format(d, "yyyy/MM/dd"), F.lit("까지")))
        .otherwise(F.concat(F.date_format(d, "yyyy년 M월 d일"), F.lit(" 오후 6시 30분")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", D.loose_moment(text, F.to_date(d), end=True).alias("moment"))


@query(
    "days_label",
    """SELECT o_orderkey, CASE WHEN n > 0 THEN 'D-' || n WHEN n = 0 THEN 'D-DAY' ELSE 'closed' END AS label
       FROM (SELECT o_orderkey, date_diff('day', DATE '1997-06-15', CAST(o_orderdate AS DATE)) AS n FROM orders)""",
)
def days_label(spark, sf_dir):
    """Days to the deadline as it is shown."""
    return table(spark, sf_dir, "orders").select("o_orderkey", D.days_label(F.to_date("o_orderdate"), F.lit("1997-06-15").cast("date")).alias("label"))


@query(
    "utc_and_local_days",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso, CAST(ts AS DATE) - INTERVAL 9 HOUR AS local_midnight FROM events""",
)
def utc_and_local_days(spark, sf_dir):
    """A UTC moment as text, and when its day begins at UTC+9, in UTC."""
    return table(spark, sf_dir, "events").select(
        "event_id", D.utc_text(F.col("ts")).alias("iso"), D.local_midnight_utc(F.to_date("ts"), "Asia/Seoul").alias("local_midnight")
    )


@query(
    "curriculum_weeks",
    """WITH g AS (SELECT l_orderkey, l_linenumber, l_shipdate, min(l_shipdate) OVER (PARTITION BY l_orderkey) AS s FROM lineitem),
       w AS (SELECT l_orderkey, l_linenumber, CAST(greatest(date_diff('day', CAST(s AS DATE), CAST(l_shipdate AS DATE)) // 7 + 1, 1) AS INTEGER) AS week FROM g)
       SELECT l_orderkey, week, string_agg(CAST(l_linenumber AS VARCHAR), ' · ' ORDER BY l_linenumber) AS subtitle FROM w GROUP BY ALL""",
)
def curriculum_weeks(spark, sf_dir):
    """Lessons by week from the first day on, those of a week merged in order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))
    first = lines.groupBy("l_orderkey").agg(F.min("day").alias("first"))
    weeks = lines.join(first, "l_orderkey").withColumn("week", D.week_number(F.col("day"), F.col("first")))
    names = F.transform(F.sort_array(F.collect_list("l_linenumber")), lambda n: n.cast("string"))
    return weeks.groupBy("l_orderkey", "week").agg(F.array_join(names, " · ").alias("subtitle"))


@query(
    "liveness_verdict",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'closed' WHEN 1 THEN 'unknown' WHEN 2 THEN 'unknown' WHEN 3 THEN 'closed' ELSE CASE WHEN contains(html, 'lang="en"') THEN 'open' ELSE 'unknown' END END AS verdict,
              CASE page_id % 5 WHEN 0 THEN 'gone' WHEN 1 THEN 'refused' WHEN 2 THEN 'login' WHEN 3 THEN 'front page' ELSE CASE WHEN contains(html, 'lang="en"') THEN 'title shown' ELSE 'not clear' END END AS reason FROM pages""",
)
def liveness_verdict(spark, sf_dir):
    """Whether a fetched posting is still open, by status, address and text."""
    k, url = F.col("page_id") % 5, F.col("url")
    site = F.regexp_extract(url, r"^(\w+://[^/?#]*)", 1)
    status = F.when(k == 0, 404).when(k == 1, 503).otherwise(200)
    final = F.when(k == 2, F.concat(site, F.lit("/login?next=1"))).when(k == 3, F.concat(site, F.lit("/"))).otherwise(url)
    shown = F.when(F.contains("html", F.lit('lang="en"')), F.lit("The Posting")).otherwise(F.lit("Some list"))
    verdict = T.liveness(url, final, status, shown, F.lit("the posting"), r"(?i)no\s+longer\s+(available|open)|(job|posting)\s+(has been\s+)?(closed|filled)")
    return table(spark, sf_dir, "pages").select("page_id", verdict.alias("v")).select("page_id", "v.verdict", "v.reason")


@query("html_visible_text")
def html_visible_text(spark, sf_dir):
    """All text that each page shows."""
    return dealt(spark, sf_dir, "pages").select("page_id", H.visible_text(F.col("html")).alias("text"))


@query("html_block_text")
def html_block_text(spark, sf_dir):
    """Each page's text with a line for each block."""
    return dealt(spark, sf_dir, "pages").select("page_id", H.block_text(F.col("html")).alias("text"))


@query("html_list_items")
def html_list_items(spark, sf_dir):
    """Items of each page's lists with place, title and absolute link."""
    items = H.list_items(F.col("html"), "nav li", "a", "https://example.com/list/")
    return dealt(spark, sf_dir, "pages").select("page_id", F.explode(items).alias("i")).select("page_id", "i.*")


@query("html_detail_fields")
def html_detail_fields(spark, sf_dir):
    """Fields of each page by selectors, and how often each was found."""
    found = H.detail_fields(F.col("html"), (("title", "title"), ("first", "p"), ("none", "section.none")))
    return dealt(spark, sf_dir, "pages").select("page_id", found.alias("f")).select(
        "page_id", *[F.try_element_at("f", F.lit(n)).alias(n) for n in ("title", "first", "none")]
    )


@query("html_sanitize")
def html_sanitize(spark, sf_dir):
    """Each page's HTML with known tags only."""
    return dealt(spark, sf_dir, "pages").select("page_id", H.sanitized(F.col("html"), "https://example.com/").alias("html"))


@query("jsonld_extract")
def jsonld_extract(spark, sf_dir):
    """Structured data of a posting in each page (put there by the query, as the tables have none)."""
    block = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","id":'), "page_id", F.lit("}]}</script>"))
    return dealt(spark, sf_dir, "pages").select("page_id", H.json_ld(F.concat("html", block), "JobPosting").alias("found"))


@query(
    "payload_flatten",
    "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'l.*.v', 'x' FROM events",
)
def payload_flatten(spark, sf_dir):
    """All leaves of each payload by path, places in lists as a star."""
    payload = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "l": [{"v": "x"}, {"v": null}]}'))
    return dealt(spark, sf_dir, "events").select("event_id", F.explode(H.json_leaves(payload)).alias("leaf")).select("event_id", "leaf.*")


@query(
    "span_resolve",
    """SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN '(Posting no. ' || doc_id || ')' END AS span FROM documents""",
)
def span_resolve(spark, sf_dir):
    """The exact piece of a text that a loosely copied piece stands for, wherever it stands; null where the text has none."""
    piece = F.concat(F.lit("(Posting no. "), F.col("doc_id"), F.lit(")"))
    half = F.floor(F.length("text") / 2).cast("int")
    whole = F.concat(F.substring("text", F.lit(1), half), F.lit("\n"), F.when(F.col("doc_id") % 4 != 3, piece).otherwise(""), F.substring(F.col("text"), half + 1, F.length("text")))
    loosely = F.concat(F.lit("( POSTING - no "), F.col("doc_id"), F.lit(" )"))
    return dealt(spark, sf_dir, "documents").select("doc_id", S.resolved_span(F.coalesce(whole, piece), loosely).alias("span"))


@query(
    "infer_paths",
    """SELECT 'k' AS path, count(*) AS hits FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""",
)
def infer_paths(spark, sf_dir):
    """Which path of the payloads holds the known value: leaves joined with values, counted by path."""
    events = dealt(spark, sf_dir, "events")
    payload = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "l": [{"v": "x"}]}'))
    leaves = events.select("event_id", F.explode(H.json_leaves(payload)).alias("leaf")).select("event_id", "leaf.*")
    wanted = events.select("event_id", F.get_json_object("props", "$.k").alias("value"))
    return leaves.join(wanted, ["event_id", "value"]).groupBy("path").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "path").limit(1)
