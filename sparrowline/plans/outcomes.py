"""Named queries: what comes of runs, lessons, deliveries and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowline.operators import answers as A
from sparrowline.operators import merge as M
from sparrowline.operators import outcomes as O
from sparrowline.plans.registry import query
from sparrowline.sources.tables import table


@query(
    "run_outcomes",
    """SELECT event_id, CASE k WHEN 0 THEN 'success' WHEN 1 THEN 'timeout' WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' WHEN 4 THEN 'failed' WHEN 5 THEN 'success' WHEN 6 THEN 'failed' ELSE 'success' END AS status,
         CASE k WHEN 2 THEN 'fetch' WHEN 3 THEN 'detail_empty' WHEN 4 THEN 'list_empty' WHEN 1 THEN CASE WHEN event_type = 'error' THEN 'fetch' END END AS error_class,
         CASE k WHEN 0 THEN 'nothing is listed: none open' WHEN 2 THEN 'no answer' WHEN 3 THEN 'no item was read: no body' WHEN 4 THEN 'no item was read' WHEN 6 THEN 'odd'
                WHEN 1 THEN CASE WHEN event_type = 'error' THEN 'no answer' END END AS error_message
       FROM (SELECT *, event_id % 8 AS k FROM events)""",
)
def run_outcomes(spark, sf_dir):
    """Each run's status with the class and words of its error; a list that says it is empty is a success, one that says nothing is not."""
    k, none = F.col("event_id") % 8, F.lit(None).cast("string")
    failed = (k == 2) | ((k == 1) & (F.col("event_type") == "error"))
    failure = F.when(failed, "fetch"), F.when(failed, "no answer").when(k == 6, "odd").otherwise(none)
    first = F.when(k == 3, "detail_empty"), F.when(k == 3, "no body")
    outcome = O.run_outcome(F.when(k == 7, 4).otherwise(0), F.when(k == 5, 2), failure, k == 1, F.when(k == 0, "none open"), first)
    return table(spark, sf_dir, "events").select("event_id", outcome.alias("o")).select("event_id", "o.*")


@query(
    "curriculum_full",
    """WITH l AS (SELECT o_custkey AS program, l_orderkey * 10 + l_linenumber AS place, CASE WHEN l_linenumber = 7 THEN '7차시' WHEN l_linenumber % 2 = 0 THEN l_linenumber || '차시  Part ' || l_suppkey % 4 ELSE ' Part ' || l_suppkey % 4 END AS name,
                CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + CAST(l_linenumber * 3 AS INTEGER) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <> 6),
         s AS (SELECT program, place, CASE WHEN name = '7차시' THEN name ELSE 'Part ' || right(name, 1) END AS name, greatest(date_diff('day', DATE '1995-06-01', a) // 7 + 1, 1) AS w,
                greatest(date_diff('day', DATE '1995-06-01', b) // 7 + 1, 1) AS e, count(*) OVER (PARTITION BY program) > 12 AS many FROM l),
         d AS (SELECT program, w, name, min(place) AS place, max(e) AS e FROM s WHERE many GROUP BY ALL)
       SELECT program, CAST(w AS INTEGER) AS start_week, CAST(max(e) AS INTEGER) AS end_week, string_agg(name, ' · ' ORDER BY place, name) AS subtitle, min(place) AS place FROM d GROUP BY program, w
       UNION ALL SELECT program, CAST(w AS INTEGER), CAST(e AS INTEGER), name, place FROM s WHERE NOT many""",
)
def curriculum_full(spark, sf_dir):
    """Lessons by week with their last week: one by one where a program has few, each week's names once where it has many; without ordinals."""
    n, day = F.col("l_linenumber"), F.to_date("l_shipdate")
    name = F.concat(F.lit("Part "), F.col("l_suppkey") % 4)
    named = F.when(n == 7, "7차시").when(n % 2 == 0, F.concat(n, F.lit("차시  "), name)).otherwise(F.concat(F.lit(" "), name))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    groups = lines.select(
        F.col("o_custkey").alias("program"), (F.col("l_orderkey") * 10 + n).alias("place"), named.alias("name"), F.when(n != 6, day).alias("first_day"),
        F.date_add(day, n * 3).alias("last_day"), F.lit("1995-06-01").cast("date").alias("program_start"),
    )
    return O.curriculum(groups, "program")


@query(
    "resend_triggers",
    """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'new' ELSE CASE k WHEN 1 THEN 'hash' WHEN 2 THEN 'status' WHEN 3 THEN 'logo' WHEN 4 THEN 'share_url' WHEN 5 THEN 'hash,logo' ELSE '' END END AS reasons,
              p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 13 <> 0 AS ready FROM (SELECT *, p_partkey % 6 AS k FROM part)""",
)
def resend_triggers(spark, sf_dir):
    """What has to go out again and why: page, state, logo and shared address each by itself; only what is ready, open and has attempts left."""
    key = F.col("p_partkey")
    k = key % 6
    pairs = {
        "hash": (F.lit("a"), F.when(k.isin(1, 5), "b").otherwise("a")), "status": (F.lit("open"), F.when(k == 2, "closed").otherwise("open")),
        "logo": (F.lit(None).cast("string"), F.when(k.isin(3, 5), "/l.png").otherwise("")), "share_url": (F.lit(""), F.when(k == 4, "/s")),
    }
    today = F.lit("2024-06-01").cast("date")
    ends = F.when(key % 7 == 0, F.date_sub(today, 1)).otherwise(today)
    ready = O.ready_to_send(key % 5 != 0, ends, today, F.when(key % 13 == 0, 3))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(O.resend_reasons(pairs, key % 11 != 0), ",").alias("reasons"), ready.alias("ready"))


@query(
    "sending_in_order",
    """WITH b AS (SELECT o_orderkey, o_custkey % 50 AS company, o_orderpriority AS title, o_orderkey % 3 <> 0 AS ok FROM orders),
         f AS (SELECT company, title, min(o_orderkey) FILTER (WHERE ok) AS first FROM b GROUP BY ALL)
       SELECT o_orderkey, CASE WHEN company = 7 THEN 'duplicate' WHEN o_orderkey > first THEN 'duplicate' WHEN ok THEN 'sent' ELSE 'failed' END AS outcome FROM b JOIN f USING (company, title)""",
)
def sending_in_order(spark, sf_dir):
    """A batch sent in its order: once one of a key goes out, the next of it are duplicates, as are those that have gone out before."""
    company = F.col("o_custkey") % 50
    batch = table(spark, sf_dir, "orders").select("o_orderkey", company.alias("company"), F.col("o_orderpriority").alias("title"))
    before = batch.filter("company = 7")
    return O.sending(batch, before, ["company", "title"], "o_orderkey", F.col("o_orderkey") % 3 != 0).select("o_orderkey", "outcome")


@query(
    "import_by_levels",
    """WITH r AS (SELECT r_regionkey AS k, r_name FROM region), n AS (SELECT n_nationkey AS k, n_regionkey, n_name FROM nation), c AS (SELECT c_custkey AS k, c_nationkey, c_name FROM customer),
         o AS (SELECT r_name || '/' || n_name || '/' || c_name AS path, o_orderkey, count(*) OVER (PARTITION BY 1) AS n FROM orders JOIN c ON c.k = o_custkey JOIN n ON n.k = c_nationkey JOIN r ON r.k = n_regionkey)
       SELECT path, CAST(count(*) AS BIGINT) AS edits, CAST(count(*) FILTER (WHERE o_orderkey % 4 = 0) AS BIGINT) AS ours FROM o WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 GROUP BY path""",
)
def import_by_levels(spark, sf_dir):
    """Another database among ours: a tree by levels, facts under it by composite keys, edits that are never overwritten; all under our ids."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    tree = (
        region.select(F.concat(F.lit("r"), "r_regionkey").alias("k"), F.lit(None).cast("string").alias("up"), F.col("r_name").alias("name"))
        .unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("k"), F.concat(F.lit("r"), "n_regionkey").alias("up"), F.col("n_name").alias("name")))
        .unionByName(customer.select(F.concat(F.lit("c"), "c_custkey").alias("k"), F.concat(F.lit("n"), "c_nationkey").alias("up"), F.col("c_name").alias("name")))
    )

    def database(salt: int, edits, said: str):
        """The tree and some edits under ids of a database's own."""

        def number(c):
            return F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(1 << 40))

        nodes = tree.select(number(F.col("k")).alias("id"), F.when(F.col("up").isNotNull(), number(F.col("up"))).alias("parent_id"), "name")
        rows = edits.select(F.col("o_orderkey").alias("id"), number(F.concat(F.lit("c"), "o_custkey")).alias("node_id"), F.col("o_orderkey").alias("part"), F.lit(said).alias("value"))
        return {"nodes": nodes, "edits": rows}

    ours = database(1, orders.filter("o_orderkey % 4 = 0"), "ours")
    # Ours lacks the customers that have no edits of ours: they come in by a level of their own.
    kept = ours["edits"].select(F.col("node_id").alias("id"))
    inner = ours["nodes"].join(customer.select(F.pmod(F.xxhash64(F.concat(F.lit("c"), "c_custkey"), F.lit(1)), F.lit(1 << 40)).alias("id")), "id", "left_anti")
    ours["nodes"] = inner.unionByName(ours["nodes"].join(kept, "id", "left_semi"))
    theirs = database(2, orders.filter("o_orderkey % 3 = 0"), "theirs")
    entities = [M.Entity("nodes", ["parent_id", "name"], {"parent_id": "nodes"}), M.Entity("edits", ["node_id", "part"], {"node_id": "nodes"})]
    found = M.import_all(entities, ours, theirs).tables
    nodes = found["nodes"]
    path = nodes.alias("c").join(nodes.alias("n"), F.col("c.parent_id") == F.col("n.id")).join(nodes.alias("r"), F.col("n.parent_id") == F.col("r.id"))
    path = path.select(F.col("c.id").alias("node_id"), F.concat_ws("/", "r.name", "n.name", "c.name").alias("path"))
    rows = found["edits"].join(path, "node_id")
    return rows.groupBy("path").agg(F.count("*").alias("edits"), F.count_if(F.col("value") == "ours").alias("ours"))


@query(
    "answers_in_full",
    """SELECT o_orderkey, CASE k WHEN 4 THEN 'unknown_field: common.odd' WHEN 5 THEN 'unparsable: postings[0].duties, postings[1].duties' WHEN 6 THEN 'unparsable: answer' END AS error,
         CASE WHEN k < 4 THEN CASE k WHEN 0 THEN '7' WHEN 1 THEN 'true' WHEN 2 THEN 'first' ELSE '' END END AS size,
         CASE WHEN k < 4 THEN CASE k WHEN 3 THEN 1 ELSE 2 END END AS postings, CASE WHEN k < 4 THEN 'lead' END AS role,
         CASE WHEN k < 4 THEN CASE k WHEN 3 THEN '' ELSE '2:' || o_orderpriority || chr(10) || '|-1:loose' END END AS duties
       FROM (SELECT *, o_orderkey % 7 AS k FROM orders)""",
)
def answers_in_full(spark, sf_dir):
    """Answers with copied pieces and their lines: values of other kinds, names that stand astray, postings that are missing, and where errors are."""
    k = F.col("o_orderkey") % 7
    size = F.when(k == 0, "7").when(k == 1, "true").when(k == 2, '["", {"line": 1, "text": " first\\n"}, "second"]').otherwise('" \\n"')
    piece = F.concat(F.lit('[{"line": '), F.when(k == 5, "2.5").otherwise("2"), F.lit(', "text": "'), F.col("o_orderpriority"), F.lit('\\n"}, "loose"]'))
    posting = F.concat(F.lit('[{"duties": '), piece, F.lit(', "role": "", "duties_evidence": "e"}, {"role": null, "name": [], "duties": '), piece, F.lit("}]"))
    postings = F.when(k == 3, '""').otherwise(posting)
    common = F.concat(F.lit('{"role": " lead ", "notes": null'), F.when(k == 4, ', "odd": 1').otherwise(""), F.lit("}"))
    answer = F.when(k == 6, "[1]").otherwise(F.concat(F.lit('{"size": '), size, F.lit(', "role": "other", "common": '), common, F.lit(', "postings": '), postings, F.lit("}")))
    shape = A.AnswerShape(top=["size"], common=["notes"], posting=["role", "name", "duties"], pieces=["notes", "name", "duties"])
    rows = A.parsed(table(spark, sf_dir, "orders").select("o_orderkey", answer.alias("answer")), "answer", shape)
    last = F.element_at("postings", -1)
    duties = F.array_join(F.transform(F.coalesce(F.try_element_at(last["pieces"], F.lit("duties")), F.array().cast(A.PIECES)), lambda p: F.concat(p["line"], F.lit(":"), p["text"])), "|")
    fine = F.col("error").isNull()
    return rows.select(
        "o_orderkey", "error", F.when(fine, F.coalesce(F.try_element_at("top", F.lit("size")), F.lit(""))).alias("size"), F.when(fine, F.size("postings")).alias("postings"),
        F.when(fine, F.try_element_at(last["texts"], F.lit("role"))).alias("role"), F.when(fine, duties).alias("duties"),
    )


@query(
    "bodies_improved",
    """WITH f AS (SELECT item_id AS doc_id, text FROM benchmark), j AS (SELECT d.doc_id, d.text AS old, f.text AS new, f.doc_id IS NOT NULL AS tried FROM documents d LEFT JOIN f USING (doc_id))
       SELECT doc_id, CAST(length(CASE WHEN tried AND doc_id % 7 <> 0 AND length(new) >= 200 AND length(new) > length(coalesce(old, '')) THEN new ELSE old END) AS INTEGER) AS size,
              CASE WHEN doc_id % 5 = 0 THEN 'noted before' WHEN NOT tried THEN NULL WHEN doc_id % 7 = 0 THEN 'error: no answer'
                   WHEN length(new) >= 200 AND length(new) > length(coalesce(old, '')) THEN 'replaced' ELSE 'unchanged' END AS outcome FROM j""",
)
def bodies_improved(spark, sf_dir):
    """Bodies looked for again: taken where they are long enough and longer, with a note of what came of it that is never overwritten."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    failed = F.col("item_id") % 7 == 0
    found = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.when(~failed, F.col("text")).alias("body"), F.when(failed, "no answer").alias("error"))
    notes = docs.filter("doc_id % 5 = 0").select("doc_id", F.lit("noted before").alias("outcome"))
    rows, noted = O.improved(docs, found, "doc_id", notes)
    return rows.join(noted, "doc_id", "left").select("doc_id", F.length("body").alias("size"), "outcome")
