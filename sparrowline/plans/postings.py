"""Named queries: filters, joins and flags over the driver's tables in the role of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowline.operators import predicates as P
from sparrowline.operators import relational as R
from sparrowline.plans.registry import query
from sparrowline.sources.tables import table

TODAY, NOW = "1997-06-15", "1997-06-15 12:00:00"


@query(
    "review_open_by_source",
    """SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       WHERE d.n_chars >= 200 AND coalesce(l.toxic, 0) = 0
       ORDER BY d.n_chars DESC, d.doc_id LIMIT 100""",
)
def review_open_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review list: postings long enough and not flagged, longest first (a top-k report)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return (
        docs.filter(F.col("n_chars") >= 200)
        .join(labels, "doc_id", "left")
        .filter(F.coalesce("toxic", F.lit(0)) == 0)
        .select("doc_id", "source", "lang", "n_chars", "quality")
        .orderBy(F.desc("n_chars"), "doc_id")
        .limit(100)
    )


@query(
    "filter_search_ilike",
    """SELECT doc_id, source, lang FROM documents
       WHERE (text ILIKE '%licen_ed under%' OR source ILIKE '%rc1%') AND lang IN ('en', 'de')""".replace("licen_ed", r"licensed"),
)
def filter_search_ilike(spark, sf_dir):
    """Substring search over several columns, whatever the case, with a value list."""
    docs = table(spark, sf_dir, "documents")
    found = P.contains_any_case([docs.text], "licensed under") | P.contains_any_case([docs.source], "RC1")
    return docs.filter(found & P.in_list(docs.lang, "en, de,en")).select("doc_id", "source", "lang")


@query(
    "filter_in_list",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')",
)
def filter_in_list(spark, sf_dir):
    """A value list from comma-joined input."""
    orders = table(spark, sf_dir, "orders")
    return orders.filter(P.in_list(F.col("o_orderpriority"), "5-LOW, 1-URGENT,,5-LOW")).select("o_orderkey", "o_orderpriority")


@query(
    "posting_filter",
    """SELECT d.doc_id, d.n_chars FROM documents d JOIN labels l USING (doc_id)
       WHERE d.text ILIKE '%the%' AND d.source IN ('src0', 'src3') AND d.lang = 'en'
         AND d.n_chars >= 300 AND l.quality = 1 AND NOT (length(trim(coalesce(d.text, ''))) >= 2000)""",
)
def posting_filter(spark, sf_dir):
    """The review filter: criteria read from text, unknown ones ignored, compiled to one predicate."""
    given = {"q": "THE", "sources": "src0,src3", "lang": "en", "deadline": "sometime", "reason": "short",
             "least_chars": "300", "quality": "1"}
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    columns = {"text": F.col("text"), "source": F.col("source"), "lang": F.col("lang"), "chars": F.col("n_chars"),
               "quality": F.col("quality")}
    reasons = {"short": F.length(F.trim(F.coalesce("text", F.lit("")))) < 2000}
    return rows.filter(P.PostingFilter.read(given).column(columns, reasons, TODAY)).select("doc_id", "n_chars")


@query(
    "deadline_state",
    f"""SELECT o_orderkey,
          CASE WHEN o_orderkey % 10 = 0 THEN 'none' WHEN CAST(o_orderdate AS DATE) >= DATE '{TODAY}' THEN 'open' ELSE 'closed' END AS state,
          (o_orderkey % 10 = 0 OR o_orderdate >= TIMESTAMP '{NOW}') AS not_past
        FROM orders""",
)
def deadline_state(spark, sf_dir):
    """Deadline as open, closed or none from text that may not be a date; and not past on the local clock."""
    orders = table(spark, sf_dir, "orders")
    unreadable = F.col("o_orderkey") % 10 == 0
    text = F.when(unreadable, F.lit("until filled")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    moment = F.when(~unreadable, F.col("o_orderdate"))
    return orders.select(
        "o_orderkey", P.deadline_state(P.day_of(text), TODAY).alias("state"), P.not_past(moment, NOW).alias("not_past")
    )


@query(
    "readiness_missing_fields",
    """SELECT c_custkey,
         concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'segment' END, CASE WHEN c_custkey % 4 = 0 THEN 'name' END,
                   CASE WHEN c_custkey % 5 = 0 THEN 'nation' END) AS missing,
         NOT (c_custkey % 3 = 0 OR c_custkey % 4 = 0 OR c_custkey % 5 = 0) AS ready
       FROM customer""",
)
def readiness_missing_fields(spark, sf_dir):
    """Which required fields are blank (null, empty or spaces), and whether none is."""
    key = F.col("c_custkey")
    required = {
        "segment": F.when(key % 3 != 0, F.col("c_mktsegment")),
        "name": F.when(key % 4 == 0, F.lit("  ")).otherwise(F.col("c_name")),
        "nation": F.when(key % 5 == 0, F.lit("")).otherwise(F.col("c_nationkey").cast("string")),
    }
    missing = P.missing_names(required)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat_ws(",", missing).alias("missing"), (F.size(missing) == 0).alias("ready")
    )


@query(
    "row_value_exclusion",
    """SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS a, o_orderpriority AS b FROM orders)
       WHERE NOT (a = 'F' AND b = '1-URGENT') AND NOT (a = 'O' AND b = '5-LOW')""",
)
def row_value_exclusion(spark, sf_dir):
    """Excluded pairs with SQL's three values: a null drops the row only where the pair could match."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("a"), "o_orderpriority")
    return rows.filter(P.not_in_pairs(F.col("a"), F.col("o_orderpriority"), [("F", "1-URGENT"), ("O", "5-LOW")])).select("o_orderkey")


@query(
    "years_cap",
    """SELECT p_partkey, (p_partkey % 7 = 0 OR (p_partkey % 11 <> 0 AND p_size <= 3)) AS within FROM part""",
)
def years_cap(spark, sf_dir):
    """Blank passes; otherwise the text must be a whole number up to the cap."""
    key = F.col("p_partkey")
    text = F.when(key % 7 == 0, F.lit(" ")).when(key % 11 == 0, F.lit("several")).otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", P.years_cap(text, 3).alias("within"))


@query(
    "allowed_categories",
    "SELECT lang, count(*) AS n FROM documents WHERE lang IN ('de', 'fr') GROUP BY lang",
)
def allowed_categories(spark, sf_dir):
    """An allow-list from settings; allowing everything would turn the filter off."""
    docs = table(spark, sf_dir, "documents").filter(P.allowed(F.col("lang"), ["fr", "de"], ["de", "en", "es", "fr"]))
    return docs.groupBy("lang").agg(F.count("*").alias("n"))


@query(
    "gate_reasons",
    """WITH r AS (
         SELECT d.doc_id, l.quality IS NULL AS empty_key,
                (CASE WHEN n_chars < 300 THEN 1 ELSE 0 END + CASE WHEN d.lang <> 'en' THEN 1 ELSE 0 END
                 + CASE WHEN coalesce(l.quality, 0) = 0 THEN 1 ELSE 0 END) >= 2 AS thin_content,
                d.source NOT IN ('src0', 'src1', 'src2', 'src3') AS off_target,
                l.quality >= 1 AND d.n_chars > 4000 AS career_cap
         FROM documents d LEFT JOIN labels l USING (doc_id))
       SELECT *, (empty_key OR thin_content OR off_target OR career_cap) AS blocked,
              NOT (empty_key OR thin_content OR off_target OR career_cap) AS ready,
              NOT (empty_key OR thin_content OR off_target OR coalesce(career_cap, false)) AS ready_strict
       FROM r""",
)
def gate_reasons(spark, sf_dir):
    """Named reasons as columns and their union and complement, unknown staying unknown."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    quality = F.col("quality")
    reasons = {
        "empty_key": quality.isNull(),
        "thin_content": P.count_true([F.col("n_chars") < 300, F.col("lang") != "en", F.coalesce(quality, F.lit(0)) == 0]) >= 2,
        "off_target": ~F.col("source").isin("src0", "src1", "src2", "src3"),
        "career_cap": (quality >= 1) & (F.col("n_chars") > 4000),
    }
    found = P.with_reasons(rows.select("doc_id", "quality", "n_chars", "lang", "source"), reasons)
    blocked = P.any_of(F.col(r) for r in reasons)
    strict = P.any_of(F.coalesce(F.col(r), F.lit(False)) for r in reasons)
    return found.select("doc_id", *reasons, blocked.alias("blocked"), (~blocked).alias("ready"), (~strict).alias("ready_strict"))


@query(
    "text_fallback",
    """SELECT page_id, coalesce(nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ''), nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '') AS text,
              length(trim(coalesce(html, ''))) < 1000 AS short
       FROM pages""",
)
def text_fallback(spark, sf_dir):
    """The first text that is not empty, and whether the page is short."""
    sources = [F.nullif(F.regexp_extract("html", f"<{t}>([^<]*)</{t}>", 1), F.lit("")) for t in ("h1", "title")]
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.coalesce(*sources, F.lit("")).alias("text"),
        (F.length(F.trim(F.coalesce("html", F.lit("")))) < 1000).alias("short"),
    )


@query(
    "recode_values",
    """SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS state,
              CAST(count(*) AS BIGINT) AS n
       FROM orders GROUP BY ALL""",
)
def recode_values(spark, sf_dir):
    """A recoding map; values without an entry pass through."""
    names = F.create_map(*[F.lit(x) for x in ("F", "finished", "O", "open")])
    state = F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", state.alias("state")).agg(F.count("*").alias("n"))


@query(
    "join_three_way",
    """SELECT c.c_custkey, c.c_name, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
       JOIN region r ON n.n_regionkey = r.r_regionkey""",
)
def join_three_way(spark, sf_dir):
    """Inner joins along keys; small dimensions are broadcast by their size."""
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_name", "n_name", "r_name")
    )


@query(
    "unclassified_anti",
    "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def unclassified_anti(spark, sf_dir):
    """Postings without a classification."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select("doc_id", "source").join(labels.select("doc_id"), "doc_id", "left_anti")


@query(
    "company_counts_zero_kept",
    """SELECT c_custkey, c_name, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey
       GROUP BY c_custkey, c_name HAVING count(o_orderkey) >= 5 OR count(o_orderkey) = 0""",
)
def company_counts_zero_kept(spark, sf_dir):
    """Counts that keep companies without any, filtered by the count. Orders are counted before the join."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"))
    companies = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = companies.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders")).filter("orders >= 5 OR orders = 0")


@query(
    "dual_dim_coalesce",
    """SELECT s.s_suppkey, coalesce(CASE WHEN s.s_acctbal > 5000 THEN own.n_name END, home.n_name) AS logo
       FROM supplier s LEFT JOIN nation own ON own.n_nationkey = s.s_nationkey
       LEFT JOIN nation home ON home.n_nationkey = own.n_regionkey""",
)
def dual_dim_coalesce(spark, sf_dir):
    """The same dimension under two keys: the company's own value, else its parent's."""
    nation = table(spark, sf_dir, "nation")
    own = nation.select(F.col("n_nationkey").alias("own_key"), F.col("n_name").alias("own"), F.col("n_regionkey").alias("parent"))
    home = nation.select(F.col("n_nationkey").alias("home_key"), F.col("n_name").alias("home"))
    suppliers = table(spark, sf_dir, "supplier").join(own, F.col("s_nationkey") == F.col("own_key"), "left")
    suppliers = suppliers.join(home, F.col("parent") == F.col("home_key"), "left")
    return suppliers.select("s_suppkey", F.coalesce(F.when(F.col("s_acctbal") > 5000, F.col("own")), "home").alias("logo"))


@query(
    "sent_flag_exists",
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS sent,
              EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS failed
       FROM customer""",
)
def sent_flag_exists(spark, sf_dir):
    """Existence in another table as flags: each lookup is joined once and can stand in any predicate."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    found = table(spark, sf_dir, "customer").select("c_custkey")
    for name, status in (("sent", "F"), ("failed", "P")):
        found = R.with_flag(found, orders.filter(F.col("o_orderstatus") == status), ["c_custkey"], name)
    return found


@query(
    "nested_not_exists",
    """SELECT c_custkey FROM customer c WHERE EXISTS (
         SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND NOT EXISTS (
           SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R'))""",
)
def nested_not_exists(spark, sf_dir):
    """Customers with an order of which nothing came back: anti join first, then semi join."""
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    clean = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(returned, "o_orderkey", "left_anti")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(clean, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query(
    "all_parts_off_target",
    """SELECT conv_id FROM conversations GROUP BY conv_id
       HAVING bool_and(coalesce(length(text), 0) < 1500) AND count(*) > 1""",
)
def all_parts_off_target(spark, sf_dir):
    """Every part of a posting meets the condition: an aggregate instead of two subqueries."""
    parts = table(spark, sf_dir, "conversations")
    off = F.bool_and(F.coalesce(F.length("text"), F.lit(0)) < 1500)
    return parts.groupBy("conv_id").agg(off.alias("off"), F.count("*").alias("n")).filter("off AND n > 1").select("conv_id")


@query(
    "null_safe_self_duplicates",
    """SELECT a.s_suppkey FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal > 0 THEN 'x' END AS grp FROM supplier) a
       WHERE EXISTS (SELECT 1 FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal > 0 THEN 'x' END AS grp FROM supplier) b
         WHERE b.s_nationkey = a.s_nationkey AND b.grp IS NOT DISTINCT FROM a.grp AND b.s_suppkey <> a.s_suppkey)""",
)
def null_safe_self_duplicates(spark, sf_dir):
    """Rows with a twin under null-safe keys and another identity, without meeting the twins pair by pair."""
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_nationkey", F.when(F.col("s_acctbal") > 0, F.lit("x")).alias("grp")
    )
    return R.duplicates_of_others(rows, ["s_nationkey", "grp"], "s_suppkey").select("s_suppkey")


@query(
    "join_on_either_key",
    """SELECT e.event_id, n.n_name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND e.event_type <> 'view'
       LEFT JOIN nation n ON n.n_nationkey = coalesce(c.c_nationkey, e.event_id % 25)""",
)
def join_on_either_key(spark, sf_dir):
    """A dimension under the first of two keys that is there."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    through = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    found = events.withColumn("user_id", F.when(F.col("event_type") != "view", F.col("user_id"))).join(through, "user_id", "left")
    key = F.coalesce(F.col("c_nationkey").cast("long"), F.col("event_id") % 25)
    nation = table(spark, sf_dir, "nation")
    return found.join(nation, key == nation.n_nationkey, "left").select("event_id", "n_name")


@query(
    "hierarchy_tree",
    """SELECT r.r_regionkey AS parent_id, r.r_name AS parent, n.n_nationkey AS child_id, n.n_name AS child
       FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey""",
)
def hierarchy_tree(spark, sf_dir):
    """Two levels of a hierarchy, kept as one table of nodes with a parent, joined with itself."""
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("id"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.lit(2).alias("level")
    )
    region = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent"), F.col("r_name").alias("name"), F.lit(1).alias("level")
    )
    nodes = region.unionByName(nation)
    top = nodes.filter("level = 1").select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    child = nodes.filter("level = 2").select(F.col("id").alias("child_id"), F.col("name").alias("child"), F.col("parent").alias("_p"))
    return top.join(child, F.col("parent_id") == F.col("_p"), "left").drop("_p")


@query(
    "recode_by_map",
    """WITH m AS (SELECT n_nationkey AS old_key, n_regionkey + 100 AS new_key FROM nation WHERE n_nationkey % 2 = 0)
       SELECT c_custkey, CAST(coalesce(m.new_key, c.c_nationkey) AS INTEGER) AS nation_key FROM customer c LEFT JOIN m ON m.old_key = c.c_nationkey""",
)
def recode_by_map(spark, sf_dir):
    """A mapping table renames what it has an entry for."""
    mapping = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    mapping = mapping.select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") + 100).alias("new_key"))
    customers = table(spark, sf_dir, "customer").join(mapping, "c_nationkey", "left")
    return customers.select("c_custkey", F.coalesce("new_key", "c_nationkey").cast("int").alias("nation_key"))


@query(
    "known_from_three_sources",
    """SELECT page_id FROM pages WHERE NOT (page_id IN (SELECT doc_id FROM labels) OR page_id IN (SELECT item_id * 3 FROM benchmark)
         OR page_id IN (SELECT conv_id * 7 FROM conversations))""",
)
def known_from_three_sources(spark, sf_dir):
    """What is new against keys from three tables: one anti join with their union."""
    keys = (
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
        .union(table(spark, sf_dir, "benchmark").select(F.col("item_id") * 3))
        .union(table(spark, sf_dir, "conversations").select(F.col("conv_id") * 7))
    )
    return table(spark, sf_dir, "pages").select("page_id").join(keys, "page_id", "left_anti")


@query(
    "array_parameter_semi",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (3, 5, 8, 13, 21)",
)
def array_parameter_semi(spark, sf_dir):
    """Keys that arrive as one JSON array."""
    keys = spark.range(1).select(F.explode(F.from_json(F.lit("[3, 5, 8, 13, 21, 5]"), "array<long>")).alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(keys, "o_custkey", "left_semi")


@query(
    "enum_lookup",
    """SELECT c_custkey, coalesce(a.n_nationkey, b.n_nationkey + 1000) AS code,
              coalesce(a.n_regionkey, b.n_regionkey) = c_custkey % 5 AS fits
       FROM customer c
       LEFT JOIN nation a ON upper(c.c_mktsegment || c.c_nationkey) = upper('BUILDING' || a.n_nationkey)
       LEFT JOIN nation b ON b.n_nationkey = c.c_nationkey AND a.n_nationkey IS NULL AND b.n_nationkey < 10""",
)
def enum_lookup(spark, sf_dir):
    """A label's code by the present list, else by the former one, and whether it fits its parent."""
    nation = table(spark, sf_dir, "nation")
    present = nation.select(
        F.concat(F.lit("BUILDING"), "n_nationkey").alias("label"), F.col("n_nationkey").alias("code_a"), F.col("n_regionkey").alias("parent_a")
    )
    former = nation.filter("n_nationkey < 10").select(
        F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") + 1000).alias("code_b"), F.col("n_regionkey").alias("parent_b")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.concat("c_mktsegment", "c_nationkey").alias("label"))
    found = customers.join(present, "label", "left").join(former, "c_nationkey", "left")
    fits = F.coalesce("parent_a", "parent_b") == F.col("c_custkey") % 5
    return found.select("c_custkey", F.coalesce("code_a", "code_b").alias("code"), fits.alias("fits"))


@query(
    "scope_select",
    """SELECT 'unclassified' AS scope, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL
       UNION ALL SELECT 'empty_fields', count(*) FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0 AND l.toxic = 0
       UNION ALL SELECT 'recent', count(*) FROM documents d WHERE d.doc_id >= (SELECT max(doc_id) - 100 FROM documents)
       UNION ALL SELECT 'all', count(*) FROM documents""",
)
def scope_select(spark, sf_dir):
    """Which postings a run covers; each scope's list is the frame that its count is taken of."""
    counts = [
        scope(spark, sf_dir, name).agg(F.lit(name).alias("scope"), F.count("*").alias("n"))
        for name in ("unclassified", "empty_fields", "recent", "all")
    ]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


def scope(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    if name == "unclassified":
        return docs.join(labels, "doc_id", "left_anti")
    if name == "empty_fields":
        return docs.join(labels.filter(P.all_of(F.coalesce(c, F.lit(0)) == 0 for c in ("quality", "toxic"))), "doc_id", "left_semi")
    if name == "recent":
        last = docs.agg(F.max("doc_id")).first()[0] or 0
        return docs.filter(F.col("doc_id") >= last - 100)
    return docs
