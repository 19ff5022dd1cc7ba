"""Named queries: where values come from, choices under a parent, answers, paragraphs, periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowline.functions import dates as D
from sparrowline.functions import html as H
from sparrowline.functions import text as T
from sparrowline.operators import predicates as P
from sparrowline.operators import relational as R
from sparrowline.operators.normalize import provenance
from sparrowline.plans.registry import query
from sparrowline.sources import payloads as J
from sparrowline.sources.tables import dealt, table


@query(
    "field_provenance",
    """SELECT d.doc_id, CASE WHEN e.conv_id IS NOT NULL THEN 'edited' WHEN l.doc_id IS NOT NULL THEN 'model'
              WHEN d.source <> 'src1' THEN 'site' ELSE 'automatic' END AS provenance
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
       LEFT JOIN (SELECT DISTINCT conv_id FROM conversations WHERE turn = 3) e ON e.conv_id = d.doc_id""",
)
def field_provenance(spark, sf_dir):
    """Whether a value was edited, came from the model, from the site, or by itself."""
    edited = table(spark, sf_dir, "conversations").filter("turn = 3").select(F.col("conv_id").alias("doc_id"))
    docs = R.with_flag(table(spark, sf_dir, "documents").select("doc_id", "source"), edited, ["doc_id"], "edited")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(True).alias("labelled"))
    rows = docs.join(labels, "doc_id", "left")
    by_model = F.coalesce(F.col("toxic") == 1, F.lit(False))
    classified = F.coalesce("labelled", F.lit(False))
    return rows.select("doc_id", provenance(F.col("edited"), by_model, classified, F.col("source") != "src1").alias("provenance"))


@query(
    "filled_summary",
    """SELECT d.doc_id, (CASE WHEN trim(coalesce(d.lang, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN l.quality IS NOT NULL THEN 1 ELSE 0 END
              + CASE WHEN l.toxic IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN d.n_chars > 0 THEN 1 ELSE 0 END) AS filled, 4 AS total
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def filled_summary(spark, sf_dir):
    """How many of a posting's classified fields are filled."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    fields = [~P.blank(F.col("lang")), F.col("quality").isNotNull(), F.col("toxic").isNotNull(), F.col("n_chars") > 0]
    return rows.select("doc_id", P.count_true(fields).alias("filled"), F.lit(len(fields)).alias("total"))


@query(
    "parent_choice_check",
    """SELECT c.c_custkey, CASE WHEN n.n_regionkey = c.c_custkey % 5 THEN NULL ELSE n.n_name || ' is not under ' || r.r_name END AS problem
       FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = c.c_custkey % 5""",
)
def parent_choice_check(spark, sf_dir):
    """A choice has to stand under the chosen parent; says which does not."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 5).alias("chosen"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = customers.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("chosen") == F.col("r_regionkey"))
    problem = F.when(F.col("n_regionkey") != F.col("chosen"), F.concat("n_name", F.lit(" is not under "), "r_name"))
    return rows.select("c_custkey", problem.alias("problem"))


@query(
    "category_fallback",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'other' END AS field,
              CASE o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o_orderstatus IN ('F', 'other-urgent') THEN o_orderstatus ELSE 'other-urgent' END
                   WHEN '2-HIGH' THEN CASE WHEN o_orderstatus IN ('O', 'P') THEN o_orderstatus ELSE 'other' END ELSE 'other' END AS role
       FROM orders""",
)
def category_fallback(spark, sf_dir):
    """What is not in the tree of choices becomes `other`, or its field's own `other`."""
    tree = {"1-URGENT": ["F", "other-urgent"], "2-HIGH": ["O", "P"]}
    field, role = T.with_other(F.col("o_orderpriority"), F.col("o_orderstatus"), tree, "other")
    return table(spark, sf_dir, "orders").select("o_orderkey", field.alias("field"), role.alias("role"))


@query(
    "image_reading",
    """SELECT p_partkey, p_size >= 20 AND p_size < 35 AS reads FROM part""",
)
def image_reading(spark, sf_dir):
    """Whether a page's images are to be read: it has some, and the text of its body is short, whatever marks it up."""
    said = F.concat(F.lit("<div><b>"), F.repeat(F.lit("twelve chars"), F.col("p_size")), F.lit("</b><span> </span></div>"))
    page = F.concat(F.lit("<html><head><title>long enough to matter</title></head><body>"), said, F.when(F.col("p_size") >= 20, "<IMG src=a.png>").otherwise("&lt;img&gt;"), F.lit("</body></html>"))
    return dealt(spark, sf_dir, "part").select("p_partkey", H.images_to_read(page, 35 * 12).alias("reads"))


@query(
    "record_assembly",
    """SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN d.lang END, CASE WHEN d.doc_id % 2 = 0 THEN 'extra' || l.quality END, d.source) AS value
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def record_assembly(spark, sf_dir):
    """A field's value: the detail's, else the list's extra one, else the list's."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    key = F.col("doc_id")
    detail = F.when(key % 3 == 0, F.col("lang")).otherwise(F.lit(" "))
    extra = F.when(key % 2 == 0, F.concat(F.lit("extra"), "quality"))
    return rows.select("doc_id", J.record(detail, extra, F.col("source")).alias("value"))


@query(
    "period_counts",
    """WITH e AS (SELECT CAST(ts AS DATE) AS day FROM events)
       SELECT count(*) FILTER (WHERE day = DATE '2024-01-20') AS today,
              count(*) FILTER (WHERE day >= DATE '2024-01-14' AND day < DATE '2024-01-21') AS "7d",
              count(*) FILTER (WHERE day >= DATE '2024-01-01' AND day < DATE '2024-01-21') AS "month",
              count(*) FILTER (WHERE day >= DATE '2023-12-01' AND day < DATE '2024-01-01') AS last_month FROM e""",
)
def period_counts(spark, sf_dir):
    """Calls by named period, in one pass."""
    today, day = F.lit("2024-01-20").cast("date"), F.to_date("ts")
    counts = []
    for name in ("today", "7d", "month", "last_month"):
        first, after = D.period_bounds(name, today)
        counts.append(F.count_if((day >= first) & (day < after)).alias(name))
    return table(spark, sf_dir, "events").agg(*counts)


@query(
    "company_and_headcount",
    """SELECT p_partkey, trim(split_part(p_name, ',', 1)) AS company, CASE WHEN p_size >= 1 THEN CAST(p_size AS BIGINT) * 1000 END AS headcount FROM part""",
)
def company_and_headcount(spark, sf_dir):
    """The first of comma-joined companies, and the first number of a text with thousands' commas."""
    key = F.col("p_partkey")
    names = F.concat("p_name", F.lit(" , "), "p_brand", F.lit(","), "p_type")
    text = F.concat(F.lit("up to "), F.format_number(F.col("p_size") * 1000, 0), F.lit(" people in 3 teams"))
    return table(spark, sf_dir, "part").select(key, T.main_of(names).alias("company"), T.first_count(text).alias("headcount"))


@query(
    "date_only_text",
    "SELECT o_orderkey, o_orderkey % 3 = 0 AS date_only FROM orders",
)
def date_only_text(spark, sf_dir):
    """Texts that are a date and nothing else."""
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(key % 3 == 0, day).when(key % 3 == 1, F.concat(day, F.lit(" 10:00"))).otherwise(F.lit("soon"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")).alias("date_only"))


@query(
    "parts_of_posting",
    """SELECT split_part(url, '#', 1) AS base, count(*) AS n, count(*) FILTER (WHERE contains(url, '#')) AS parts FROM pages GROUP BY 1""",
)
def parts_of_posting(spark, sf_dir):
    """A posting and its parts, `url` and `url#...`, found by one key instead of by prefix."""
    url = F.col("url")
    return dealt(spark, sf_dir, "pages").groupBy(T.without_fragment(url).alias("base")).agg(
        F.count("*").alias("n"), F.count_if(F.contains(url, F.lit("#"))).alias("parts")
    )


@query(
    "talent_pool_exclusion",
    """SELECT s_suppkey FROM (SELECT s_suppkey, lower(replace(s_name || CASE s_suppkey % 9 WHEN 0 THEN ' Talent Pool 2024' WHEN 1 THEN ' 인재 등록 안내' WHEN 2 THEN ' 2026 인재DB'
         WHEN 3 THEN ' 상시 등록' WHEN 4 THEN ' 인재 Pool' WHEN 5 THEN ' 인재풀' WHEN 6 THEN ' DB 등록용' WHEN 7 THEN ' 인력풀' ELSE '' END, ' ', '')) AS t FROM supplier)
       WHERE NOT (contains(t, 'talentpool') OR contains(t, '인재등록') OR contains(t, '인재db') OR contains(t, '상시등록') OR contains(t, '인재pool') OR contains(t, '인재풀') OR contains(t, 'db등록'))""",
)
def talent_pool_exclusion(spark, sf_dir):
    """Titles that only gather applicants are left out, however they are spaced."""
    key = F.col("s_suppkey")
    said = (" Talent \t POOL 2024", " 인재\u3000등록 안내", " 2026 인재DB", " 상시 등록", " 인재 Pool", " 인재풀", " DB 등록용", " 인력풀", "")
    title = F.concat("s_name", F.element_at(F.array(*map(F.lit, said)), (key % 9 + 1).cast("int")))
    return table(spark, sf_dir, "supplier").filter(~T.is_talent_pool(title)).select("s_suppkey")


@query(
    "parent_groups_without_logo",
    """SELECT c.n_nationkey, (c.n_nationkey % 2 = 0) AS no_logo, EXISTS (SELECT 1 FROM nation x WHERE x.n_regionkey = c.n_nationkey) AS is_parent FROM nation c""",
)
def parent_groups_without_logo(spark, sf_dir):
    """Companies without a logo, and those that others name as their parent."""
    nation = table(spark, sf_dir, "nation")
    logo = F.when(F.col("n_nationkey") % 2 == 1, F.col("n_name")).otherwise(F.lit(""))
    rows = nation.select("n_nationkey", P.blank(logo).alias("no_logo"))
    parents = nation.select(F.col("n_regionkey").cast("int").alias("n_nationkey"))
    return R.with_flag(rows, parents, ["n_nationkey"], "is_parent")


LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SPACES = r"[ \t\x{A0}\x{3000}\x{200B}]+"
ENDS = r"^[\s\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}]+|[\s\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}]+$"


@query(
    "text_paragraphs",
    rf"""WITH safe AS (SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS t FROM documents),
       joined AS (SELECT doc_id, array_to_string(list_transform(string_split_regex(t, '{LINES}'), lambda x: regexp_replace(regexp_replace(x, '{SPACES}', ' ', 'g'), '{ENDS}', '', 'g')), chr(10)) AS t FROM safe),
       blocks AS (SELECT doc_id, list_filter(string_split_regex(trim(t, chr(10)), '\n\n+'), lambda p: p <> '') AS b FROM joined)
       SELECT doc_id, CASE WHEN len(b) > 0 THEN array_to_string(list_transform(b, lambda p: '<p>' || replace(p, chr(10), '<br>') || '</p>'), '') END AS html FROM blocks""",
)
def text_paragraphs(spark, sf_dir):
    """Texts as paragraphs of HTML."""
    return table(spark, sf_dir, "documents").select("doc_id", T.paragraphs(F.col("text")).alias("html"))


@query(
    "selector_coverage",
    """WITH m(name, n) AS (SELECT 'title', 1 FROM part UNION ALL SELECT 'item', p_size % 3 FROM part UNION ALL SELECT 'body', CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END FROM part
         UNION ALL SELECT 'never', 0 FROM part)
       SELECT name, CAST(sum(n) AS BIGINT) AS matches, count(*) FILTER (WHERE n > 0) AS pages_ok, count(*) FILTER (WHERE n = 0) AS pages_failed,
              coalesce(sum(n), 0) = 0 AS missing FROM m GROUP BY name""",
)
def selector_coverage(spark, sf_dir):
    """How often each selector of a set finds something: one parse a page, counted by selector."""
    items = F.repeat(F.lit('<li class="job open"><a href="/x">x</a></li>'), (F.col("p_size") % 3).cast("int"))
    page = F.concat(F.lit("<title>t</title><ul id=jobs>"), items, F.lit("</ul><li class=job>no</li>"), F.when(F.col("p_size") % 2 == 0, "<article><p>b</article>").otherwise("<p>b"))
    selectors = (("title", "title"), ("item", "#jobs li.job.open"), ("body", "article p"), ("never", "blink"))
    each = dealt(spark, sf_dir, "part").select(F.explode(H.selector_counts(page, selectors)).alias("name", "n"))
    return each.groupBy("name").agg(
        F.sum("n").alias("matches"), F.count_if(F.col("n") > 0).alias("pages_ok"), F.count_if(F.col("n") == 0).alias("pages_failed"),
        (F.coalesce(F.sum("n"), F.lit(0)) == 0).alias("missing"),
    )


@query(
    "first_answer_per_field",
    """SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS r
         FROM conversations WHERE trim(coalesce(text, '')) <> '') WHERE r = 1""",
)
def first_answer_per_field(spark, sf_dir):
    """Of several answers for a field the first that is not empty, by one aggregation."""
    rows = table(spark, sf_dir, "conversations").filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    first = rows.groupBy("conv_id", "role").agg(F.min(F.struct("turn", "text")).alias("x"))
    return first.select("conv_id", "role", "x.text")


@query(
    "quote_grounded_names",
    r"""SELECT doc_id, CASE WHEN blank THEN 0 ELSE 1 END AS kept, CASE WHEN blank THEN 'real,ghost' ELSE 'ghost' END AS lost
        FROM (SELECT doc_id, coalesce(regexp_matches(substr(text, 1, 20), '^[\s]*$'), true) AS blank FROM documents)""",
)
def quote_grounded_names(spark, sf_dir):
    """Names whose quote is in the source, and those that have none."""
    quote = F.substring("text", 1, 20)
    items = F.array(
        F.struct(F.lit("real").alias("name"), quote.alias("quote")), F.struct(F.lit("ghost").alias("name"), F.lit("qqzz xxjj never said").alias("quote"))
    )
    kept, lost = T.grounded_names(items, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(kept).alias("kept"), F.array_join(lost, ",").alias("lost"))


@query(
    "empty_list_notice",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN trim(substr(repeat('ab ', 20) || 'No open positions' || repeat(' cd', 20), 41, 57))
              WHEN s_suppkey % 3 = 1 THEN '채용 공고가 현재 없습니다' ELSE '' END AS notice FROM supplier""",
)
def empty_list_notice(spark, sf_dir):
    """What a page says where nothing is listed, with some words around it."""
    key = F.col("s_suppkey")
    text = (
        F.when(key % 3 == 0, F.concat(F.repeat(F.lit("ab "), 20), F.lit("No open positions"), F.repeat(F.lit(" cd"), 20)))
        .when(key % 3 == 1, F.lit("채용 공고가 현재 없습니다"))
        .otherwise(F.col("s_name"))
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.empty_notice(text).alias("notice"))
