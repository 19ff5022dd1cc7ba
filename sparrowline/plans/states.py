"""Named queries: rules and layers of normalization, merges, and state over runs.

Old state and changes are two slices of one table, so that SQL can compute the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowline.operators import merge as M
from sparrowline.operators import normalize as N
from sparrowline.operators import relational as R
from sparrowline.operators import rules as U
from sparrowline.operators import stateful as S
from sparrowline.plans.registry import query
from sparrowline.plans.reports import RUNS_SQL, runs
from sparrowline.sources.scratch import new_folder
from sparrowline.sources.tables import table
from sparrowline.streaming import runs as ST


def rule(i, field, kind, priority, config, enabled=1):
    import json

    return U.read_rule({"id": i, "field_name": field, "rule_type": kind, "priority": priority, "rule_config_json": json.dumps(config), "enabled": enabled})


TITLE_RULES = [
    (1, "title", "trim", 10, {"collapse": True}),
    (2, "title", "regex", 20, {"pattern": r"^Customer#0*(\d+)$", "replacement": r"No. \1"}),
    (3, "title", "mapping", 30, {"map": {"No. 7": "", "No. 8": "Eight"}}),
    (4, "title", "regex", 40, {"pattern": "^$", "replacement": "never reached"}),
    (5, "title", "trim", 5, {"chars": "x"}, 0),
]
TITLE_SQL = """CASE c_custkey WHEN 7 THEN NULL WHEN 8 THEN 'Eight' ELSE regexp_replace(c_name, '^Customer#0*(\\d+)$', 'No. \\1') END""".replace("\\\\", "\\")


@query("rules_trim_regex_mapping", f"SELECT c_custkey, {TITLE_SQL} AS title FROM customer")
def rules_trim_regex_mapping(spark, sf_dir):
    """A field's rules in order; an emptied value stops them and is null in the end."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" \n")).alias("title"), F.lit("2024-01-01").cast("date").alias("on"))
    return U.normalized(rows, [rule(*r) for r in TITLE_RULES], ["title"], "on").select("c_custkey", "title")


@query(
    "rule_failures",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'recruitment_end_at: date_parse 2' END AS error,
              CASE WHEN o_orderkey % 7 = 0 THEN 'sometime' WHEN o_orderkey % 7 = 1 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 23:59:59' END AS ends FROM orders""",
)
def rule_failures(spark, sf_dir):
    """A row that a rule cannot read keeps its value and an error; an emptied value is no failure."""
    k = F.col("o_orderkey") % 7
    text = F.when(k == 0, "sometime").when(k == 1, "always open").otherwise(F.date_format("o_orderdate", "yyyy.M.d"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("recruitment_end_at"), F.to_date("o_orderdate").alias("on"))
    found = [rule(1, "recruitment_end_at", "mapping", 1, {"map": {"always open": ""}}), rule(2, "recruitment_end_at", "date_parse", 2, {"formats": ["%Y-%m-%d", "%Y.%m.%d"]})]
    out = U.normalized(rows, found, ["recruitment_end_at"], "on")
    return out.select("o_orderkey", "error", F.when(F.col("error").isNotNull(), "sometime").otherwise(F.col("recruitment_end_at")).alias("ends"))


@query(
    "rule_trace",
    """SELECT c_custkey, CAST(unnest([1, 2, 9, 3]) AS INTEGER) AS rule, unnest([c_name, regexp_replace(c_name, '^Customer#0*(\\d+)$', 'No. \\1'),
              'draft ' || regexp_replace(c_name, '^Customer#0*(\\d+)$', 'No. \\1'), 'draft ' || regexp_replace(c_name, '^Customer#0*(\\d+)$', 'No. \\1')]) AS value FROM customer""".replace("\\\\", "\\"),
)
def rule_trace(spark, sf_dir):
    """A value after each rule, with an unsaved draft among them."""
    saved = [rule(*r) for r in TITLE_RULES[:3]]
    draft = rule(9, "title", "regex", 25, {"pattern": "^(?=.)", "replacement": "draft "})
    steps = U.traced(F.concat(F.col("c_name"), F.lit(" ")), saved, "title", F.lit("2024-01-01").cast("date"), draft)
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(steps).alias("s")).select("c_custkey", "s.rule", "s.value")


@query(
    "settle_fields",
    """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS headcount,
              CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN CAST(o_orderkey % 40 AS VARCHAR) END AS least,
              CASE o_orderstatus WHEN 'O' THEN CAST(o_orderkey % 40 AS VARCHAR) END AS most,
              CASE WHEN o_orderkey % 2 = 0 THEN 'ALWAYS_OPEN' ELSE 'PERIOD' END AS kind FROM orders""",
)
def settle_fields(spark, sf_dir):
    """The last step of normalization: numbers, years by kind, and what follows from the deadline."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    count = F.when(F.col("o_custkey") % 3 == 0, "00").otherwise(F.concat(F.lit("0 or "), F.format_number("o_custkey", 0), F.lit(" people, 9 groups")))
    years = F.concat(F.lit(" "), (key % 40).cast("string"))
    fields = {
        "recruitment_headcount": count,
        "experience_type": F.when(status == "F", "NEWCOMER").when(status == "O", "EXPERIENCED").otherwise("IRRELEVANT"),
        "employment_type": F.lit("REGULAR"),
        "experience_min_years": years,
        "experience_max_years": years,
        N.END: F.when(key % 2 == 0, "2999-12-31 23:59:59").otherwise("2024-01-01 23:59:59"),
    }
    out = N.settled(fields)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", out["recruitment_headcount"].alias("headcount"), out["experience_min_years"].alias("least"),
        out["experience_max_years"].alias("most"), out["recruitment_type"].alias("kind"),
    )


@query(
    "overlay_precedence",
    """SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.doc_id % 7 = 0 THEN 'person' WHEN l.doc_id IS NULL THEN d.lang
                WHEN l.quality = 1 THEN 'model' END AS field,
              CASE WHEN d.doc_id % 11 = 0 OR d.doc_id % 7 = 0 THEN 'edited' WHEN l.doc_id IS NOT NULL THEN 'model' ELSE 'site' END AS source
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def overlay_precedence(spark, sf_dir):
    """Rule value, then classification (blank clears), then a person's override (blank clears), and where the value is from."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("classified"))
    edits = table(spark, sf_dir, "documents").filter("doc_id % 11 = 0 OR doc_id % 7 = 0")
    edits = edits.select(F.col("doc_id").alias("raw_job_id"), F.lit(1).alias("part"), F.lit("field").alias("field_name"), F.when(F.col("doc_id") % 11 == 0, "").otherwise("person").alias("value"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(1).alias("part")).join(labels, "doc_id", "left")
    rows = rows.join(N.overrides_by_posting(edits, ["field"]).withColumnRenamed("raw_job_id", "doc_id"), ["doc_id", "part"], "left")
    classified = F.coalesce("classified", F.lit(False))
    value = N.overlay(F.col("lang"), classified, F.when(F.col("quality") == 1, "model").otherwise(" "))
    edited = F.try_element_at("overrides", F.lit("field")).isNotNull()
    source = N.provenance(edited, F.lit(False), classified, F.lit(True))
    return rows.select("doc_id", N.overridden("field", value).alias("field"), source.alias("source"))


@query(
    "parts_expand",
    """WITH n AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations WHERE role <> 'system')
       SELECT d.doc_id, coalesce(n.turn, 1) AS part, CASE WHEN n.c > 1 THEN 'u' || d.doc_id || '#' || n.turn ELSE 'u' || d.doc_id END AS url
       FROM documents d LEFT JOIN n ON n.conv_id = d.doc_id""",
)
def parts_expand(spark, sf_dir):
    """A row for each part of a posting, the address numbered where there are several."""
    from sparrowline.functions.text import part_url

    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("raw_job_id"))
    parts = table(spark, sf_dir, "conversations").filter("role <> 'system'").select(F.col("conv_id").alias("raw_job_id"), F.col("turn").alias("part"))
    rows = N.expand_parts(raw, parts)
    url = part_url(F.concat(F.lit("u"), "raw_job_id"), F.col("part"), F.col("split"))
    return rows.select(F.col("raw_job_id").alias("doc_id"), F.col("part").cast("long").alias("part"), url.alias("url"))


@query(
    "canonical_company",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Supplier Nr ' || s_nationkey ELSE 'Own ' || s_suppkey || ' (주)' END AS company FROM supplier""",
)
def canonical_company(spark, sf_dir):
    """Spellings of a company made one: without a legal form first, then the first registered."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    known = nation.select(F.col("k").alias("id"), F.concat(F.lit("(주)Supplier Nr "), "k").alias("name"), F.concat(F.lit("P"), "k").alias("parent_name"))
    known = known.union(nation.select(F.col("k") + 100, F.concat(F.lit("Supplier Nr "), "k"), F.concat(F.lit("P"), "k")))
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.concat(F.lit("P"), "s_nationkey").alias("parent"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("supplier nr. "), "s_nationkey", F.lit(" 주식회사"))).otherwise(F.concat(F.lit("Own "), "s_suppkey", F.lit(" (주)"))).alias("name"),
    )
    return N.canonical_names(rows, known).select("s_suppkey", F.col("canonical").alias("company"))


@query(
    "normalize_full",
    """WITH l AS (SELECT * FROM labels)
       SELECT d.doc_id AS raw_job_id, 1 AS part, CASE WHEN d.doc_id % 13 = 0 THEN 'By hand' ELSE d.source || ' ' || d.lang END AS title,
              strftime(TIMESTAMP '2024-01-10' + to_days(CAST(d.doc_id % 60 AS INTEGER)), '%Y-%m-%d') || ' 23:59:59' AS recruitment_end_at,
              CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN 'EXPERIENCED' ELSE 'IRRELEVANT' END AS experience_type,
              CASE WHEN l.quality = 1 THEN CAST(d.doc_id % 9 AS VARCHAR) END AS experience_min_years, 'PERIOD' AS recruitment_type
       FROM documents d LEFT JOIN l USING (doc_id) WHERE d.doc_id % 17 <> 0""",
)
def normalize_full(spark, sf_dir):
    """The whole normalization: rules, classification, fallbacks, company, title, overrides, logo, settled fields."""
    raw, rules, classes, edits, companies = normalization_inputs(spark, sf_dir)
    good, _ = N.normalize(raw, rules, classes, edits, companies)
    return good.select("raw_job_id", "part", "title", "recruitment_end_at", "experience_type", "experience_min_years", "recruitment_type")


@query(
    "normalize_parts_and_companies",
    """WITH d AS (SELECT doc_id AS k FROM documents WHERE doc_id % 17 <> 0), p AS (SELECT k, unnest(CASE WHEN k % 2 = 0 THEN [1, 2] ELSE [1] END) AS part FROM d),
       n AS (SELECT *, CASE WHEN k % 3 = 0 THEN CASE k % 4 WHEN 0 THEN 'Firm' WHEN 1 THEN '(주)Other' WHEN 3 THEN 'Solo' END END AS company FROM p)
       SELECT k AS raw_job_id, CAST(part AS INTEGER) AS part, CASE WHEN k % 2 = 0 THEN 'u' || k || '#' || part ELSE 'u' || k END AS source_url, 'P' || (k % 3) AS parent_company_name, company AS company_name,
              CASE WHEN company = '(주)Other' THEN 'other-logo' WHEN k % 3 = 0 THEN 'logo' WHEN k % 5 = 0 THEN 'icon' || k END AS logo_url, CASE WHEN k % 7 = 0 THEN 'cover' || k END AS cover_image_url,
              CASE WHEN k % 2 = 0 THEN CAST(part * 1000 AS VARCHAR) ELSE '3' END AS recruitment_headcount, CASE WHEN k % 2 = 0 THEN '2024-01-02 00:00:00' ELSE '2024-01-05 00:00:00' END AS recruitment_start_at FROM n""",
)
def normalize_parts_and_companies(spark, sf_dir):
    """The whole normalization over several companies with and without legal forms, postings of two parts, logos, icons, covers and counts."""
    raw, rules, classes, edits, _ = normalization_inputs(spark, sf_dir)
    k = F.col("raw_job_id")
    names = F.element_at(F.array(F.lit("Firm (주)"), F.lit(" 주식회사 Other"), F.lit(None).cast("string"), F.lit("Solo")), (k % 4 + 1).cast("int"))
    raw = raw.withColumns({"company_name": names, "site_icon": F.when(k % 5 == 0, F.concat(F.lit("icon"), k)).otherwise(" "), "cover_image_url": F.when(k % 7 == 0, F.concat(F.lit("cover"), k))})
    count = F.concat(F.format_number(F.col("part") * 1000, 0), F.lit(" people"))
    both = raw.filter(k % 2 == 0).select(k, F.explode(F.array(F.lit(1), F.lit(2))).alias("part")).withColumn("c_recruitment_headcount", count)
    same = [c for c in classes.columns if c not in both.columns]
    classes = both.select("*", *[F.lit(None).cast("boolean" if c == "dates_by_ai" else "string").alias(c) for c in same])
    companies = spark.createDataFrame([(1, "Firm", "P0", None), (2, "P0", None, "logo"), (3, "(주)Other", "P0", "other-logo")], "id long, name string, parent_name string, logo_url string")
    good, _ = N.normalize(raw, rules, classes, edits, companies)
    return good.select("raw_job_id", "part", "source_url", "parent_company_name", "company_name", "logo_url", "cover_image_url", "recruitment_headcount", "recruitment_start_at")


@query("normalize_failures", "SELECT doc_id AS raw_job_id, 'recruitment_end_at: date_parse 3' AS error FROM documents WHERE doc_id % 17 = 0")
def normalize_failures(spark, sf_dir):
    """Postings that a rule could not read, each with the rule."""
    _, bad = N.normalize(*normalization_inputs(spark, sf_dir))
    return bad


def normalization_inputs(spark, sf_dir):
    none = F.lit(None).cast("string")
    day = F.date_add(F.lit("2024-01-10").cast("date"), (F.col("doc_id") % 60).cast("int"))
    ends = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("2024.1.2 ～ "), F.date_format(day, "yyyy.M.d"))).otherwise(F.date_format(day, "yyyy-MM-dd"))
    ends = F.when(F.col("doc_id") % 17 == 0, "sometime").otherwise(ends)
    title = F.concat("source", F.lit("  "), "lang", F.lit(" "))
    raw = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("raw_job_id"), F.concat(F.lit("u"), "doc_id").alias("source_url"), F.lit("2024-01-05").cast("date").alias("collected"),
        F.concat(F.lit("P"), F.col("doc_id") % 3).alias("parent"), (F.col("doc_id") % 3 == 0).alias("affiliates"), title.alias("title"),
        F.lit("Firm (주)").alias("company_name"), none.alias("recruitment_start_at"), ends.alias("recruitment_end_at"), F.lit("0 of 3").alias("recruitment_headcount"),
        none.alias("experience_type"), none.alias("employment_type"), none.alias("experience_min_years"), none.alias("experience_max_years"),
    )
    rules = [
        rule(1, "title", "trim", 1, {"collapse": True}),
        rule(2, "recruitment_end_at", "regex", 1, {"pattern": r"^.*~\s*", "replacement": ""}),
        rule(3, "recruitment_end_at", "date_parse", 2, {"formats": ["%Y-%m-%d", "%Y.%m.%d"]}),
        rule(4, "recruitment_start_at", "date_parse", 1, {"formats": ["%Y.%m.%d"]}),
        rule(5, "title", "date_parse", 9, {"formats": ["%Y-%m-%d"]}, 0),  # not enabled
    ]
    classes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("raw_job_id"), F.lit(1).alias("part"), F.lit("").alias("role"), none.alias("posting_title"), F.lit(False).alias("dates_by_ai"),
        F.lit("").alias("c_company_name"), none.alias("c_recruitment_start_at"), none.alias("c_recruitment_end_at"), none.alias("c_recruitment_headcount"),
        F.when(F.col("quality") == 1, "EXPERIENCED").otherwise(" ").alias("c_experience_type"), F.lit("REGULAR").alias("c_employment_type"),
        (F.col("doc_id") % 9).cast("string").alias("c_experience_min_years"), none.alias("c_experience_max_years"),
    )
    edits = table(spark, sf_dir, "documents").filter("doc_id % 13 = 0")
    edits = edits.select(F.col("doc_id").alias("raw_job_id"), F.lit(1).alias("part"), F.lit("title").alias("field_name"), F.lit(" By hand ").alias("value"))
    companies = spark.createDataFrame([(1, "Firm", "P0", None), (2, "P0", None, "logo")], "id long, name string, parent_name string, logo_url string")
    return raw, rules, classes, edits, companies


@query(
    "merge_upsert",
    """SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey""",
)
def merge_upsert(spark, sf_dir):
    """Insert or replace: the last change to a key counts."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    half = orders.agg(F.max("o_orderkey")).first()[0] // 2
    old = R.latest(orders.filter(F.col("o_orderkey") <= half), ["o_custkey"], "o_orderkey")
    return M.upsert(old, orders.filter(F.col("o_orderkey") > half), ["o_custkey"], "o_orderkey")


@query("merge_insert_if_absent", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def merge_insert_if_absent(spark, sf_dir):
    """Inserts only what is not there, the first of several."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    half = orders.agg(F.max("o_orderkey")).first()[0] // 2
    old = orders.filter(F.col("o_orderkey") <= half).groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return M.insert_absent(old, orders.filter(F.col("o_orderkey") > half), ["o_custkey"], "o_orderkey")


@query(
    "merge_attempts",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 6 = 0 THEN c_custkey * 10 WHEN c_custkey % 2 = 0 THEN c_custkey END AS remote_id,
              CASE WHEN c_custkey % 3 = 0 THEN 'sent' ELSE 'failed' END AS status, CAST((c_custkey % 2 = 0)::INT * 2 + (c_custkey % 3 = 0)::INT AS INTEGER) AS attempts,
              CASE WHEN c_custkey % 2 = 0 THEN 'old' END AS sent_at FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""",
)
def merge_attempts(spark, sf_dir):
    """Deliveries after tries: one attempt more, known ids and times kept where a try brings none."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    old = c.filter("c_custkey % 2 = 0").select("c_custkey", F.col("c_custkey").alias("remote_id"), F.lit("failed").alias("status"), F.lit(2).alias("attempts"), F.lit("old").alias("sent_at"))
    tried = c.filter("c_custkey % 3 = 0").select(
        "c_custkey", F.when(F.col("c_custkey") % 6 == 0, F.col("c_custkey") * 10).alias("remote_id"), F.lit("sent").alias("status"), F.lit(None).cast("string").alias("sent_at")
    )
    return M.record_attempts(old, tried, "c_custkey")


@query(
    "merge_conditional_reset",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE 'old' END AS content_hash, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 3 END AS attempts, p_partkey % 4 <> 0 AS hidden FROM part""",
)
def merge_conditional_reset(spark, sf_dir):
    """Targets start anew only where their content changed."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    old = p.select("p_partkey", F.lit("old").alias("content_hash"), F.lit(3).alias("attempts"), F.lit(True).alias("hidden"))
    new = p.filter("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "new").otherwise("old").alias("content_hash"))
    return M.retarget(old, new, "p_partkey")


@query(
    "merge_gate_attempts",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'first' ELSE 'later' END AS reasons, CAST((p_partkey % 2 = 0)::INT + (p_partkey % 3 = 0)::INT AS INTEGER) AS attempts
       FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""",
)
def merge_gate_attempts(spark, sf_dir):
    """Gate runs count attempts and keep the first reasons."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    old = p.filter("p_partkey % 2 = 0").withColumns({"reasons": F.lit("first"), "attempts": F.lit(1)})
    return M.count_gate(old, p.filter("p_partkey % 3 = 0").withColumn("reasons", F.lit("later")), "p_partkey")


@query(
    "merge_change_detect",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 <> 0 THEN 'a' WHEN p_partkey % 3 = 0 THEN 'b' WHEN p_partkey % 5 = 0 THEN 'c' ELSE 'a' END AS page_hash,
              CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'NEW' WHEN p_partkey % 2 <> 0 THEN 'MISSING' WHEN p_partkey % 5 = 0 THEN 'CHANGED' ELSE 'SAME' END AS change,
              CASE WHEN p_partkey % 2 = 0 AND (p_partkey % 3 = 0 OR p_partkey % 5 = 0) THEN 0 ELSE 2 END AS attempts
       FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0""",
)
def merge_change_detect(spark, sf_dir):
    """New, changed, same and missing pages; a change starts anew."""
    p, k = table(spark, sf_dir, "part").select("p_partkey"), F.col("p_partkey")
    old = p.filter("p_partkey % 3 <> 0").withColumns({"page_hash": F.lit("a"), "attempts": F.lit(2), "error": F.lit("e"), "last_seen": F.lit("before")})
    new = p.filter("p_partkey % 2 = 0").withColumn("page_hash", F.when(k % 3 == 0, "b").when(k % 5 == 0, "c").otherwise("a"))
    return M.detect_changes(old, new, "p_partkey", "now").select("p_partkey", "page_hash", "change", "attempts")


@query("history_replace", "SELECT p_partkey, 'old' AS content_hash, 77 AS run_id FROM part WHERE p_partkey % 4 = 0")
def history_replace(spark, sf_dir):
    """What rows were before they were swapped."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    old = p.withColumn("content_hash", F.lit("old"))
    new = p.filter("p_partkey % 2 = 0").withColumn("content_hash", F.when(F.col("p_partkey") % 4 == 0, "new").otherwise("old"))
    return M.replace_with_history(old, new, "p_partkey", 77)[1]


@query(
    "discard_cascade_counts",
    """SELECT 'parents' AS "table", count(*) AS deleted FROM orders WHERE o_orderstatus = 'P'
       UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""",
)
def discard_cascade_counts(spark, sf_dir):
    """A deletion carried through to the dependent table, with rows deleted by table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    gone = orders.filter("o_orderstatus = 'P'").select("o_orderkey")
    return M.discard(orders, {"lines": lines}, gone, "o_orderkey", F.lit("withdrawn"))[2]


@query(
    "import_id_remap",
    """WITH t AS (SELECT c_name, min(c_custkey) AS their_id FROM customer WHERE c_custkey % 2 = 0 GROUP BY c_name),
       o AS (SELECT c_name, c_custkey AS id FROM customer WHERE c_custkey % 3 = 0)
       SELECT t.their_id, coalesce(o.id, (SELECT max(id) FROM o) + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY t.their_id)) AS our_id FROM t LEFT JOIN o USING (c_name)""",
)
def import_id_remap(spark, sf_dir):
    """Another database's rows found by natural key or added with new ids."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return M.import_rows(c.filter("id % 3 = 0"), c.filter("id % 2 = 0"), ["c_name"], "id")[1]


@query(
    "json_key_rename",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS place FROM events",
)
def json_key_rename(spark, sf_dir):
    """A key renamed inside a JSON map where it is there."""
    said = M.rename_keys(F.from_json("props", "map<string,string>"), {"k": "place", "none": "x"})
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(said, F.lit("place")).alias("place"))


@query("json_array_edit", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '%Y.%m.%d|%Y-%m-%d' ELSE '%Y-%m-%d|%Y.%m.%d' END AS formats FROM nation")
def json_array_edit(spark, sf_dir):
    """Lists of formats without those that lack a year, with one that may be missing."""
    has = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("%m.%d"), F.lit("%Y.%m.%d"), F.lit("%Y-%m-%d"))).otherwise(F.array(F.lit("%Y-%m-%d"), F.lit("%d")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(M.edit_formats(has, "^[^Yy]*$", ["%Y.%m.%d"]), "|").alias("formats"))


@query("orphans_closed", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'timeout' ELSE o_orderstatus END AS status FROM orders")
def orphans_closed(spark, sf_dir):
    """Runs without an end count as timed out."""
    status = M.close_orphans(F.nullif("o_orderstatus", F.lit("P")))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@query(
    "incremental_landing",
    """WITH b AS (SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS h FROM events WHERE event_id % 2 = 1),
       k AS (SELECT user_id, event_type FROM events WHERE event_id % 2 = 0 AND value < 5), l AS (SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) AS h FROM events WHERE event_id % 10 = 0)
       SELECT user_id, count(DISTINCT event_type) AS kinds FROM b WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = b.user_id AND k.event_type = b.event_type)
         AND NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = b.user_id AND l.h = b.h) GROUP BY user_id""",
)
def incremental_landing(spark, sf_dir):
    """What a batch brings that no list knows, by address and then by content."""
    events = table(spark, sf_dir, "events").withColumn("h", F.floor("value"))
    batch = events.filter("event_id % 2 = 1").select("event_id", "user_id", "event_type", "h")
    known = events.filter("event_id % 2 = 0 AND value < 5").select("user_id", "event_type")
    landed = events.filter("event_id % 10 = 0").select("user_id", "h").distinct()
    fresh = batch.join(known, ["user_id", "event_type"], "left_anti").join(landed, ["user_id", "h"], "left_anti")
    return fresh.groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"))


TRUST_SQL = """WITH r AS (SELECT event_id AS run_id, user_id AS source, event_type <> 'error' AS ok, CAST(floor(value) AS BIGINT) AS matched FROM events),
  c AS (SELECT *, coalesce(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY source ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM r),
  g AS (SELECT source, row_number() OVER o AS n, median(matched) OVER (o ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS usual FROM r WHERE ok WINDOW o AS (PARTITION BY source ORDER BY run_id))
  SELECT run_id, CASE WHEN NOT ok THEN 'not successful' WHEN c.n < 3 THEN 'too few runs to compare' WHEN matched < usual * 0.5 THEN 'far fewer than usual' END AS reason
  FROM c LEFT JOIN g ON g.source = c.source AND g.n = c.n"""


@query("median_trust_gate", TRUST_SQL)
def median_trust_gate(spark, sf_dir):
    """Which runs can be trusted to tell what is missing, against the median of the last seven good ones."""
    return _trust_gate(table(spark, sf_dir, "events"))


@query("median_trust_gate_all", TRUST_SQL)
def median_trust_gate_all(spark, sf_dir):
    """`median_trust_gate`, by the name that tests against brute force use."""
    return median_trust_gate(spark, sf_dir)


def _trust_gate(events):
    runs_ = events.select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("source"), F.lit(True).alias("complete"), F.lit(True).alias("scheduled"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.lit(0).alias("list_misses"), F.lit(False).alias("capped"),
        F.floor("value").alias("matched"),
    )
    return S.trust(runs_).select("run_id", "reason")


MISSED_SQL = """WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'error'),
 tot AS (SELECT user_id, max(n) AS total FROM t GROUP BY 1),
 u AS (SELECT DISTINCT user_id, event_id % 7 AS url FROM events),
 s AS (SELECT e.user_id, e.event_id % 7 AS url, max(t.n) AS last_n FROM events e JOIN t ON t.user_id = e.user_id AND t.event_id = e.event_id GROUP BY ALL)
 SELECT u.user_id AS source, u.url, CAST(total - coalesce(last_n, 0) AS INTEGER) AS missed_runs, total - coalesce(last_n, 0) >= 3 AS closed
 FROM u JOIN tot USING (user_id) LEFT JOIN s ON s.user_id = u.user_id AND s.url = u.url"""


@query("missed_run_state", MISSED_SQL)
def missed_run_state(spark, sf_dir):
    """Postings by how many trusted runs in a row have not shown them; three close one."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("run_id"), "event_type")
    trusted = events.filter("event_type <> 'error'").select("source", "run_id")
    seen = events.select("source", "run_id", (F.col("run_id") % 7).alias("url"))
    postings = seen.select("source", "url").distinct().withColumn("since", F.lit(None).cast("long"))
    return S.missed_state(trusted, postings, seen).select("source", "url", "missed_runs", "closed")


@query(
    "first_run_cap",
    """SELECT event_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 5 OR user_id % 2 = 0""",
)
def first_run_cap(spark, sf_dir):
    """The first run of a source is capped (the feature); sources that have had new rows are not."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    done = events.select("user_id", (F.when(F.col("user_id") % 2 == 0, 3).otherwise(0)).alias("new_count"))
    return S.first_run_cap(events, done, "user_id", "event_id", 5).select("event_id")


@query(
    "retry_budget",
    """SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0 OR (c_custkey % 5 < 3 AND c_custkey % 4 < 3)""",
)
def retry_budget(spark, sf_dir):
    """What is to be sent: never sent, or failed with attempts left."""
    k = F.col("c_custkey")
    status = F.when(k % 5 == 0, None).when(k % 5 < 3, "failed").otherwise("sent")
    return table(spark, sf_dir, "customer").filter(S.unsent(status, k % 4)).select("c_custkey")


@query("batch_one_of_each", "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def batch_one_of_each(spark, sf_dir):
    """Within a batch, sending one makes the next a duplicate: one of each key is left."""
    return S.one_of_each(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("resume_from_cursor", "SELECT o_orderkey FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 30")
def resume_from_cursor(spark, sf_dir):
    """The next slice after where the last run stopped (the slice is the feature)."""
    return S.next_slice(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 700, 30)


@query("resume_from_start", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30")
def resume_from_start(spark, sf_dir):
    """The first slice again once the last run has come to the end of the table (the slice is the feature)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return S.next_slice(orders, "o_orderkey", orders.agg(F.max("o_orderkey")).first()[0], 30)


@query("judge_once_per_url", "SELECT page_id, length(split_part(url, '#', 1)) AS verdict FROM pages".replace("length(", "CAST(length(").replace(") AS verdict", ") AS INTEGER) AS verdict"))
def judge_once_per_url(spark, sf_dir):
    """A judgement made once for each address and shared by its parts."""
    from sparrowline.functions.text import without_fragment

    judged = S.judge_once(table(spark, sf_dir, "pages").select("page_id", "url"), without_fragment(F.col("url")), lambda u: u.withColumn("verdict", F.length("_url")))
    return judged.select("page_id", "verdict")


@query(
    "reuse_or_work",
    """SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'reuse' WHEN doc_id % 5 >= 3 THEN 'give_up' ELSE 'work' END AS action FROM documents""",
)
def reuse_or_work(spark, sf_dir):
    """Earlier results used again, targets given up after too many failures, the rest worked on."""
    targets = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).alias("failures"))
    return S.reusable(targets, table(spark, sf_dir, "labels"), ["doc_id"], 3).select("doc_id", "action")


@query(
    "stop_after_failures",
    f"""WITH {RUNS_SQL}, g AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY user_id ORDER BY id) AS grp FROM runs),
        n AS (SELECT *, sum(failed::INT) OVER (PARTITION BY user_id, grp ORDER BY id) AS in_row FROM g),
        f AS (SELECT user_id, min(id) FILTER (WHERE in_row >= 4) AS stop FROM n GROUP BY 1)
        SELECT n.id FROM n JOIN f USING (user_id) WHERE stop IS NULL OR id <= stop""",
)
def stop_after_failures(spark, sf_dir):
    """Results up to where four in a row have failed."""
    return S.stops_at(runs(spark, sf_dir), "user_id", "id", F.col("failed"), 4).select("id")


@query(
    "rework_trigger",
    "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0",
)
def rework_trigger(spark, sf_dir):
    """Pages that changed since they were last worked on and have not ended."""
    k = F.col("p_partkey")
    done = F.when(k % 3 == 0, "a").when(k % 3 == 1, "b")
    return table(spark, sf_dir, "part").filter(S.needs_work(done, F.lit("a"), F.when(k % 7 == 0, F.lit(True)))).select("p_partkey")


@query(
    "gate_loop",
    """SELECT p_partkey, CAST(CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 20 THEN 1 ELSE 2 END AS INTEGER) AS attempts, p_size > 30 AS caught FROM part""",
)
def gate_loop(spark, sf_dir):
    """Rows that the gate catches are worked on again, twice at most."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    out = S.gate_rounds(rows, lambda d: d["p_size"] > 10, lambda d: {"p_size": d["p_size"] - 10})
    return out.select("p_partkey", "attempts", "caught")


@query(
    "accept_if_better",
    """SELECT d.doc_id, (length(b.text) >= 200 AND length(b.text) > d.n_chars) AS accepted FROM documents d JOIN benchmark b ON b.item_id = d.doc_id""",
)
def accept_if_better(spark, sf_dir):
    """A new body taken only if it is long enough and longer than the old one."""
    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").alias("n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(new, "doc_id")
    return rows.select("doc_id", ((F.col("n") >= 200) & (F.col("n") > F.col("n_chars"))).alias("accepted"))


@query(
    "deadline_changes",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'found' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0""",
)
def deadline_changes(spark, sf_dir):
    """Deadlines that were found or changed between two snapshots; cleared ones do not count."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 != 0, "a").alias("before"), F.when((k % 3 == 0) | (k % 5 == 0), "b").when(k % 7 != 0, "a").alias("after"))
    change = F.when(F.col("after").isNotNull() & F.col("before").isNull(), "found").when(F.col("after") != F.col("before"), "changed")
    return rows.select("o_orderkey", change.alias("change")).filter("change IS NOT NULL")


@query(
    "run_status",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'timeout' WHEN event_type = 'error' OR (value < 50 AND event_id % 3 <> 0) THEN 'failed' ELSE 'success' END AS status FROM events""",
)
def run_status(spark, sf_dir):
    """A run's status: over time, failed (or nothing done and nothing skipped), else successful."""
    done, skipped = F.col("value") >= 50, F.col("event_id") % 3 == 0
    status = F.when(F.col("event_id") % 4 == 0, "timeout").when((F.col("event_type") == "error") | (~done & ~skipped), "failed").otherwise("success")
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"))


@query("outbound_payload", "SELECT o_orderkey, '{\"id\":' || o_orderkey || ',\"state\":\"' || o_orderstatus || '\"}' AS payload FROM orders")
def outbound_payload(spark, sf_dir):
    """Rows as they go out: renamed, checked and as JSON."""
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))).alias("payload"))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """Each source and kind once, by Structured Streaming over the table's file."""
    schema = table(spark, sf_dir, "events").schema
    events = ST.read_folder(spark, f"{sf_dir.rstrip('/')}", schema, "events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    out = new_folder(spark, "dedup")
    ST.drain(ST.first_of_key(events, ["user_id", "event_type"], "at", "3650 days").select("user_id", "event_type"), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema("user_id long, event_type string").parquet(f"{out}/rows")


@query(
    "stream_daily_counts",
    """WITH w AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, (SELECT max(ts) FROM events) AS top FROM events GROUP BY 1, 2)
       SELECT day, event_type, n FROM w WHERE day + INTERVAL 1 DAY <= top - INTERVAL 1 DAY""",
)
def stream_daily_counts(spark, sf_dir):
    """Counts by day and kind, given out as the watermark closes the days."""
    schema = table(spark, sf_dir, "events").schema
    events = ST.read_folder(spark, f"{sf_dir.rstrip('/')}", schema, "events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    out = new_folder(spark, "daily")
    counts = ST.windowed_counts(events, "at", "event_type").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
    ST.drain(counts, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema("day timestamp_ntz, event_type string, n long").parquet(f"{out}/rows")
