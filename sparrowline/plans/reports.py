"""Named queries: counts, rates, costs, windows, duplicate groups, run history and paging."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparrowline.operators import predicates as P
from sparrowline.operators import relational as R
from sparrowline.plans.registry import query
from sparrowline.sources.tables import table



@query(
    "reason_counts",
    """SELECT count(*) AS total, count(*) FILTER (WHERE n_chars < 300) AS short, count(*) FILTER (WHERE lang <> 'en') AS foreign_lang,
              count(*) FILTER (WHERE text ILIKE '%license%') AS licensed FROM documents""",
)
def reason_counts(spark, sf_dir):
    """Many conditional counts in one pass."""
    reasons = {
        "short": F.col("n_chars") < 300,
        "foreign_lang": F.col("lang") != "en",
        "licensed": P.contains_any_case([F.col("text")], "license"),
    }
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in reasons.items()])


@query(
    "fill_rates",
    """WITH t AS (SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS quality, count(*) FILTER (WHERE toxic = 1) AS toxic,
                         count(*) FILTER (WHERE doc_id % 8 = 0) AS eighth FROM labels)
       SELECT f.field, f.filled, total, CAST(CASE WHEN total = 0 THEN 0 ELSE round_even(100.0::DOUBLE * f.filled / total, 0) END AS BIGINT) AS percent
       FROM t, LATERAL (VALUES ('quality', quality), ('toxic', toxic), ('eighth', eighth)) AS f(field, filled)""",
)
def fill_rates(spark, sf_dir):
    """How many rows fill each field, and the percentage, in one pass."""
    filled = {"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "eighth": F.col("doc_id") % 8 == 0}
    return R.fill_rates(table(spark, sf_dir, "labels"), filled)


@query(
    "status_counts_zero_filled",
    """SELECT s.status, count(o.o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status)
       LEFT JOIN orders o ON o.o_orderstatus = s.status GROUP BY s.status""",
)
def status_counts_zero_filled(spark, sf_dir):
    """Counts over a fixed list of states, also those that do not occur."""
    domain = spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "status string")
    return R.zero_filled(domain, table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), "status", "n")


@query(
    "filtered_counts",
    """SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value IS NULL) AS unknown, count(*) AS n
       FROM events GROUP BY event_type""",
)
def filtered_counts(spark, sf_dir):
    """Filtered counts by group; comparisons with null count as no."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value").isNull()).alias("unknown"), F.count("*").alias("n")
    )


@query(
    "distinct_over_fanout",
    "SELECT o_orderpriority, count(DISTINCT o_orderkey) AS orders, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
)
def distinct_over_fanout(spark, sf_dir):
    """Distinct ids over a join's fan-out: lines are counted by order first, so that orders are not repeated."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(lines, "o_orderkey")
    return joined.groupBy("o_orderpriority").agg(F.count_distinct("o_orderkey").alias("orders"), F.sum("n").alias("lines"))


@query(
    "any_part_flag",
    "SELECT conv_id, bool_or(role = 'system') AS has_system, max(CASE WHEN text ILIKE '%the%' THEN 1 ELSE 0 END) AS hit FROM conversations GROUP BY conv_id",
)
def any_part_flag(spark, sf_dir):
    """Whether any part of a posting meets a condition."""
    hit = P.contains_any_case([F.col("text")], "the").cast("int")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.bool_or(F.col("role") == "system").alias("has_system"), F.max(hit).alias("hit")
    )


@query(
    "top_reasons",
    """SELECT split_part(url, '//', 1) || '//' || split_part(regexp_replace(split_part(url, '//', 2), '[?#].*', ''), '/', 1) AS reason, count(*) AS n
       FROM pages GROUP BY 1 ORDER BY n DESC, reason LIMIT 5""",
)
def top_reasons(spark, sf_dir):
    """The five most frequent kinds after their variable ends are cut off."""
    kind = F.concat(F.substring_index("url", "//", 1), F.lit("//"), F.split_part(F.regexp_replace(F.split_part("url", F.lit("//"), F.lit(2)), "[?#].*", ""), F.lit("/"), F.lit(1)))
    counts = table(spark, sf_dir, "pages").groupBy(kind.alias("reason")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "reason").limit(5)


def calls(spark, sf_dir):
    """Model calls: events in that role."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("at"),
        F.concat(F.lit("f"), F.col("user_id") % 3).alias("feature"),
        F.col("event_type").alias("model"),
        (F.col("event_type") != "error").alias("ok"),
        F.floor("value").alias("input_tokens"),
        (F.floor("value") * 2).alias("output_tokens"),
    )


PRICES = [("signup", 2.0, 8.0), ("view", 0.5, 1.5), ("purchase", 10.0, 30.0)]
CALLS_SQL = """calls AS (
  SELECT ts, 'f' || (user_id % 3) AS feature, event_type AS model, event_type <> 'error' AS ok,
         CAST(floor(value) AS BIGINT) AS i, CAST(floor(value) AS BIGINT) * 2 AS o FROM events),
price(model, ip, op) AS (VALUES ('signup', 2.0::DOUBLE, 8.0::DOUBLE), ('view', 0.5::DOUBLE, 1.5::DOUBLE), ('purchase', 10.0::DOUBLE, 30.0::DOUBLE)),
grouped AS (
  SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, feature, model, count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS failed,
         CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens FROM calls GROUP BY 1, 2, 3),
cost AS (SELECT g.*, (input_tokens * ip + output_tokens * op) / 1e6::DOUBLE AS cost FROM grouped g LEFT JOIN price p ON p.model = g.model)"""


def prices(spark):
    return spark.createDataFrame(PRICES, "model string, input_price double, output_price double")


@query(
    "cost_daily_tz",
    f"WITH {CALLS_SQL} SELECT day, feature, model, calls, failed, input_tokens, output_tokens, cost FROM cost",
)
def cost_daily_tz(spark, sf_dir):
    """Calls by local day, feature and model with their cost; models without a price have none."""
    found = R.cost_by_day(calls(spark, sf_dir), prices(spark), "Asia/Seoul")
    return found.select("day", "feature", "model", "calls", "failed", "input_tokens", "output_tokens", "cost")


@query(
    "cost_rollup",
    f"""WITH {CALLS_SQL},
     named AS (SELECT *, CASE feature WHEN 'f0' THEN 'reading' ELSE feature END AS grp FROM cost)
     SELECT 'group' AS kind, grp AS name, CAST(sum(calls) AS BIGINT) AS calls,
            CAST(coalesce(sum(CASE WHEN cost IS NULL THEN calls END), 0) AS BIGINT) AS unpriced FROM named GROUP BY grp
     UNION ALL SELECT 'model', model, CAST(sum(calls) AS BIGINT), CAST(coalesce(sum(CASE WHEN cost IS NULL THEN calls END), 0) AS BIGINT) FROM named GROUP BY model
     UNION ALL SELECT 'all', 'all', CAST(sum(calls) AS BIGINT), CAST(coalesce(sum(CASE WHEN cost IS NULL THEN calls END), 0) AS BIGINT) FROM named""",
)
def cost_rollup(spark, sf_dir):
    """One grouped frame rolled up by group of features (renamed where a name is given), by model and in all."""
    names = F.create_map(F.lit("f0"), F.lit("reading"))
    grouped = R.cost_by_day(calls(spark, sf_dir), prices(spark), "Asia/Seoul")
    grouped = grouped.withColumn("grp", F.coalesce(F.try_element_at(names, F.col("feature")), F.col("feature")))
    sums = grouped.groupingSets([["grp"], ["model"], []], "grp", "model").agg(
        F.grouping_id().alias("g"),
        F.sum("calls").alias("calls"),
        F.coalesce(F.sum(F.when(F.col("cost").isNull(), F.col("calls"))), F.lit(0)).alias("unpriced"),
    )
    kind = F.when(F.col("g") == 1, "group").when(F.col("g") == 2, "model").otherwise("all")
    return sums.select(kind.alias("kind"), F.coalesce("grp", "model", F.lit("all")).alias("name"), "calls", "unpriced")


@query(
    "cost_period_change_forecast",
    """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1),
     w AS (SELECT month, n, lag(n) OVER (ORDER BY month) AS before FROM m)
     SELECT CAST(month AS DATE) AS month, n, CAST(CASE WHEN before > 0 THEN round_even(100.0::DOUBLE * (n - before) / before, 1) END AS DOUBLE) AS change,
            CAST(round_even(n / 10.0::DOUBLE * day(last_day(month)), 2) AS DOUBLE) AS forecast FROM w""",
)
def cost_period_change_forecast(spark, sf_dir):
    """Month against the month before, and a month's forecast from its first ten days' rate; division only where it can be."""
    months = table(spark, sf_dir, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(W.orderBy("month"))  # a row a month
    months = months.withColumn("before", before)
    change = F.when(F.col("before") > 0, F.bround(100.0 * (F.col("n") - F.col("before")) / F.col("before"), 1))
    forecast = F.bround(F.col("n") / F.lit(10.0) * F.day(F.last_day("month")), 2)
    return months.select("month", "n", change.alias("change"), forecast.alias("forecast"))


DUP_SQL = """kept AS (SELECT event_id, user_id, event_type FROM events WHERE value >= 20),
groups AS (SELECT user_id, event_type, count(*) AS size FROM kept WHERE event_type <> 'view' GROUP BY ALL HAVING count(*) > 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY size DESC, user_id, event_type) AS group_no FROM groups)"""


@query("dup_groups", f"WITH {DUP_SQL} SELECT user_id, event_type, size, group_no FROM numbered")
def dup_groups(spark, sf_dir):
    """Duplicate groups inside a filter, blank keys left out, numbered by size."""
    kept = table(spark, sf_dir, "events").filter("value >= 20").select("event_id", "user_id", "event_type")
    groups = R.duplicate_groups(kept, ["user_id", "event_type"], F.col("event_type") != "view")
    return R.number_groups(groups, ["user_id", "event_type"])


@query(
    "dup_rows_numbered",
    f"WITH {DUP_SQL} SELECT k.event_id, n.size, n.group_no FROM kept k JOIN numbered n ON n.user_id = k.user_id AND n.event_type = k.event_type",
)
def dup_rows_numbered(spark, sf_dir):
    """All rows of the duplicate groups with their group's number and size."""
    kept = table(spark, sf_dir, "events").filter("value >= 20").select("event_id", "user_id", "event_type")
    groups = R.duplicate_groups(kept, ["user_id", "event_type"], F.col("event_type") != "view")
    return kept.join(R.number_groups(groups, ["user_id", "event_type"]), ["user_id", "event_type"]).select("event_id", "size", "group_no")


@query(
    "group_size_window",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS size FROM orders",
)
def group_size_window(spark, sf_dir):
    """Each row with the size of its group."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    sizes = orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("size"))  # rows never meet, only counts
    same = F.col("o.o_custkey").eqNullSafe(F.col("s.o_custkey")) & F.col("o.o_orderpriority").eqNullSafe(F.col("s.o_orderpriority"))
    return orders.alias("o").join(sizes.alias("s"), same).select("o_orderkey", "size")


@query(
    "latest_per_key",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def latest_per_key(spark, sf_dir):
    """The latest row of each key by one aggregation."""
    return R.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey").select(
        "o_custkey", "o_orderkey", "o_orderstatus"
    )


RUNS_SQL = """runs AS (SELECT event_id AS id, user_id, ts, event_type, event_type IN ('error', 'click') AS failed FROM events WHERE event_type <> 'signup'),
streak AS (SELECT r.user_id, count(*) FILTER (WHERE r.id > coalesce(g.good, -1)) AS streak
           FROM runs r JOIN (SELECT user_id, max(id) FILTER (WHERE NOT failed) AS good FROM runs GROUP BY 1) g USING (user_id) GROUP BY 1)"""


def runs(spark, sf_dir):
    """Runs of sources: events in that role; sign-ups are runs that are still open and do not count."""
    rows = table(spark, sf_dir, "events").filter("event_type <> 'signup'")
    return rows.select(F.col("event_id").alias("id"), "user_id", "ts", "event_type", "value", F.col("event_type").isin("error", "click").alias("failed"))


@query(
    "failure_streak",
    f"""WITH {RUNS_SQL} SELECT user_id, streak, CASE WHEN streak >= 3 THEN 'stopped' WHEN streak >= 2 THEN 'warning' WHEN streak = 1 THEN 'notice' ELSE 'ok' END AS severity,
        streak >= 3 AS auto_stop FROM streak""",
)
def failure_streak(spark, sf_dir):
    """Failures in a row up to the last run, how severe they are, and whether the source stops."""
    found = R.streaks(runs(spark, sf_dir), "user_id", "id", F.col("failed"))
    return found.select("user_id", "streak", R.severity(F.col("streak"), 3).alias("severity"), (F.col("streak") >= 3).alias("auto_stop"))


@query(
    "round_summary",
    """SELECT user_id, CAST(ts AS DATE) AS day, max_by(event_type, event_id) AS status, CAST(count(*) AS BIGINT) AS runs, min(ts) AS started, max(ts) AS finished
       FROM events GROUP BY 1, 2""",
)
def round_summary(spark, sf_dir):
    """By source and day: the last run's status, counts over all runs, first start and last end."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.max_by("event_type", "event_id").alias("status"), F.count("*").alias("runs"), F.min("ts").alias("started"), F.max("ts").alias("finished")
    )


@query(
    "recent_average",
    """SELECT user_id, avg(value) AS average, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3
       GROUP BY user_id""".replace("avg(value) AS average", "round(avg(value), 6) AS average"),
)
def recent_average(spark, sf_dir):
    """Averages over each key's last three calls."""
    last = R.last_n(table(spark, sf_dir, "events"), "user_id", [F.desc("event_id")], 3)
    return last.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("average"), F.count("*").alias("n"))


@query(
    "runs_by_kind",
    """SELECT o.o_orderpriority AS kind, date_trunc('year', l.l_shipdate) AS year, CAST(count(*) AS BIGINT) AS runs, CAST(sum(l_linenumber) AS BIGINT) AS rows_done
       FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY 1, 2""",
)
def runs_by_kind(spark, sf_dir):
    """Sums over joined runs by kind and period."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber")
    joined = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    year = F.date_trunc("year", "l_shipdate").cast("timestamp_ntz")
    return joined.groupBy(F.col("o_orderpriority").alias("kind"), year.alias("year")).agg(
        F.count("*").alias("runs"), F.sum("l_linenumber").alias("rows_done")
    )


@query(
    "custom_value_counts",
    "SELECT lang AS field, count(*) FILTER (WHERE trim(coalesce(source, '')) <> '') AS n FROM documents GROUP BY lang",
)
def custom_value_counts(spark, sf_dir):
    """Values by field that are not blank."""
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("field")).agg(F.count_if(~P.blank(F.col("source"))).alias("n"))


@query("sort_boolean_first", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY l.doc_id IS NOT NULL, d.doc_id LIMIT 50")
def sort_boolean_first(spark, sf_dir):
    """Sorted by a condition, then by id: unlabelled ones first (a top-k report)."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"), "quality")
    joined = table(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("labelled"), "left")
    return joined.orderBy(F.col("labelled").isNotNull(), "doc_id").limit(50).select("doc_id", "quality")


@query("offset_page_clamped", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def offset_page_clamped(spark, sf_dir):
    """The third page of a sorted list."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return R.offset_page(orders, [F.desc("o_totalprice"), F.col("o_orderkey")], page=3, size=20)


@query(
    "keyset_page",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1996-03-01' OR (o_orderdate = TIMESTAMP '1996-03-01' AND o_orderkey > 500)
       ORDER BY o_orderdate, o_orderkey LIMIT 101""",
)
def keyset_page(spark, sf_dir):
    """The pull feed: rows after a position, one more than a page to know whether there are others."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return R.keyset_page(orders, "o_orderdate", "o_orderkey", ("1996-03-01 00:00:00", 500), 100)


@query("remaining_today", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05')")
def remaining_today(spark, sf_dir):
    """Active sources less those already done on the day."""
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    done = events.filter(F.to_date("ts") == F.lit("2024-01-05").cast("date"))
    return events.select("user_id").distinct().join(done.select("user_id"), "user_id", "left_anti")


@query(
    "names_unknown_first",
    """SELECT DISTINCT name FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT NULL) ORDER BY name NULLS FIRST""",
)
def names_unknown_first(spark, sf_dir):
    """Names of two sources and the unknown one, each once, the unknown one first."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "region").select("r_name"))
    return names.union(spark.sql("SELECT CAST(NULL AS STRING)")).distinct().orderBy(F.asc_nulls_first("name"))


@query(
    "schedule_slots",
    """SELECT s_suppkey, TIMESTAMP '2024-01-05 09:00:00' + to_seconds((row_number() OVER (ORDER BY s_suppkey) - 1) * (36000 // (SELECT count(*) FROM supplier))) AS starts
       FROM supplier""",
)
def schedule_slots(spark, sf_dir):
    """Evenly spaced starts for all sources in the time that is left (a row a source)."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    placed = R.numbered(suppliers, [F.asc("s_suppkey")], "place").crossJoin(F.broadcast(suppliers.agg(F.count("*").alias("n"))))  # one row
    seconds = (F.col("place") - 1) * F.floor(F.lit(36000) / F.col("n"))
    return placed.select("s_suppkey", F.expr("TIMESTAMP_NTZ '2024-01-05 09:00:00'").alias("_t"), seconds.alias("_s")).select(
        "s_suppkey", F.expr("_t + make_dt_interval(0, 0, 0, _s)").alias("starts")
    )


@query(
    "price_resolution",
    """SELECT p_partkey, CASE WHEN p_size > 40 THEN round(p_retailprice / 2, 2) WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) THEN 49.0
         WHEN p_brand < 'Brand#3' THEN p_retailprice END AS price FROM part WHERE p_size > 40 OR p_brand < 'Brand#3' OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)""",
)
def price_resolution(spark, sf_dir):
    """Prices of several sources; the last source that has one counts."""
    parts = table(spark, sf_dir, "part")
    sold = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    frames = [
        parts.filter("p_brand < 'Brand#3'").select("p_partkey", F.col("p_retailprice").alias("price")),
        parts.join(sold, "p_partkey", "left_semi").select("p_partkey", F.lit(49.0).alias("price")),
        parts.filter("p_size > 40").select("p_partkey", F.round(F.col("p_retailprice") / 2, 2).alias("price")),
    ]
    return R.first_of_priority(frames, "p_partkey")
