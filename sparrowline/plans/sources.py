"""Named queries: programs from CSV files, checked imports, feeds with acknowledgement, notices and icons of pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sparrowline.functions import html as H
from sparrowline.functions import pages as P
from sparrowline.operators import relational as R
from sparrowline.plans.registry import query
from sparrowline.sources import payloads as J
from sparrowline.sources.scratch import new_folder, written
from sparrowline.sources.tables import dealt, table


@query(
    "csv_programs",
    """SELECT CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey // 10 * 10 + 1 + (c_custkey % 10 - 1) // 3 AS VARCHAR) END AS id, count(*) FILTER (WHERE c_custkey % 10 <> 0 AND (c_custkey % 10 - 1) % 3 = 0) AS taken,
              count(*) FILTER (WHERE c_custkey % 10 = 0) AS without_key, count(*) FILTER (WHERE c_custkey % 10 <> 0 AND (c_custkey % 10 - 1) % 3 <> 0) AS repeated,
              max(CASE WHEN c_custkey % 10 <> 0 AND (c_custkey % 10 - 1) % 3 = 0 THEN '이름 "' || c_name || '",' || chr(10) || 'second line' END) AS name FROM customer GROUP BY 1""",
)
def csv_programs(spark, sf_dir):
    """Programs of CSV files in an older encoding, with quotes and line feeds in cells: the first of each key, others with the reason."""
    k = F.col("c_custkey")
    within = k % 10
    key = F.when(within != 0, F.floor(k / 10) * 10 + 1 + F.floor((within - 1) / 3))
    name = F.concat(F.lit('이름 "'), F.when((within - 1) % 3 == 0, F.col("c_name")).otherwise("later"), F.lit('",\nsecond line'))
    folder = new_folder(spark, "programs")
    rows = table(spark, sf_dir, "customer").select("c_custkey", key.alias("id"), name.alias("name")).repartitionByRange(F.floor(k / 1000)).sortWithinPartitions("c_custkey")

    def in_older_encoding(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: c.encode("euc-kr").decode("latin-1"))

    older = F.pandas_udf(in_older_encoding, "string")
    rows.select("id", older("name").alias(" name ")).write.option("encoding", "iso-8859-1").option("escape", '"').csv(folder, header=True)
    programs, skipped = J.read_programs(spark, folder, ["id", "name"], "id", ["utf-8", "euc-kr"])
    every = programs.withColumn("reason", F.lit(None).cast("string")).unionByName(skipped)
    taken = F.col("reason").isNull()
    return every.groupBy("id").agg(
        F.count_if(taken).alias("taken"), F.count_if(F.col("reason") == "no key").alias("without_key"), F.count_if(F.col("reason") == "repeated").alias("repeated"), F.max(F.when(taken, F.col("name"))).alias("name"),
    )


@query(
    "program_sections",
    """SELECT p_partkey, '{' || CASE WHEN p_size % 3 = 0 THEN '' ELSE '"about":{"name":"' || p_name || '"' || CASE WHEN p_size % 3 = 1 THEN ',"kind":"' || p_type || '"' ELSE '' END || '},' END || '"who":{"brand":"' || p_brand || '"}}' AS sections FROM part""",
)
def program_sections(spark, sf_dir):
    """A program's texts by section: stripped, without empty texts and without sections that have none."""
    k = F.col("p_size") % 3
    about = {"name": F.when(k != 0, F.concat(F.lit("\t"), "p_name", F.lit(" \n"))), "kind": F.when(k == 1, F.col("p_type")).otherwise(" \n")}
    rows = dealt(spark, sf_dir, "part").select("p_partkey", J.sections({"about": about, "who": {"brand": F.col("p_brand"), "none": F.lit(None).cast("string")}}).alias("s"))
    return rows.select("p_partkey", F.to_json("s").alias("sections"))


@query("import_checked", "SELECT n_regionkey, count(*) AS nations, 'column no is missing' AS refused, true AS sized FROM nation GROUP BY 1")
def import_checked(spark, sf_dir):
    """Files that are checked before they are imported: their size, their kind, their version, and their columns."""
    nations = written(table(spark, sf_dir, "nation"), "given")
    size = J.checked_files(spark, nations.inputFiles()[0].rsplit("/", 1)[0], b"PAR1")
    good = J.checked_import(nations, {"n_regionkey": "int", "n_name": "string"}, 3, 3)
    try:
        J.checked_import(nations, {"no": "string"}, 3, 3)
        refused = ""
    except ValueError as e:
        refused = str(e)
    return good.groupBy("n_regionkey").agg(F.count("*").alias("nations"), F.lit(refused).alias("refused"), F.lit(size > 0).alias("sized"))


@query(
    "feed_acknowledged",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'before' WHEN r <= 1500 THEN 'now' END AS delivered_at, CASE WHEN r > 1500 THEN 'unasked' WHEN event_id % 5 = 0 THEN 'already' ELSE 'marked' END AS outcome
       FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r FROM events)""",
)
def feed_acknowledged(spark, sf_dir):
    """The feed read in three pages of 500 by its cursor, and what was read acknowledged twice; a cursor goes on where the page before it ended."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 5 == 0, "before").alias("delivered_at"))
    cursor, read = None, []
    for _ in range(3):  # a page has 500 rows at most
        page, _, cursor = R.read_feed(events, "ts", "event_id", cursor, 500)
        read += [(r.event_id,) for r in page]
    asked = spark.createDataFrame(read, "event_id long")
    marked, outcome = R.acknowledge(events, asked, "event_id", "delivered_at", "now")
    again, _ = R.acknowledge(marked, asked, "event_id", "delivered_at", "later")
    return again.join(outcome, "event_id", "left").select("event_id", "delivered_at", F.coalesce("outcome", F.lit("unasked")).alias("outcome"))


@query(
    "page_notices_and_icons",
    """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'No open positions' WHEN 1 THEN '채용 공고가 현재 없' END AS notice,
              CASE s_suppkey % 4 WHEN 0 THEN '/og.png' WHEN 1 THEN '/touch.png' WHEN 2 THEN '/128.png' END AS image FROM supplier""",
)
def page_notices_and_icons(spark, sf_dir):
    """What a page says where it lists nothing, and its image: its own for sharing, else the best icon."""
    k = F.col("s_suppkey")
    said = F.when(k % 3 == 0, "<p>No  open\npositions</p>").when(k % 3 == 1, "<p>채용 공고가<br>현재 없습니다</p>").otherwise(F.concat(F.lit("<li>"), "s_name"))
    small, large = '<link rel="icon" sizes="16x16" href="/16.png">', '<link rel="icon" sizes="128x128" href="/128.png">'
    head = F.when(k % 4 == 0, small + '<meta property="og:image" content="/og.png">').when(k % 4 == 1, large + '<link rel="apple-touch-icon" href="/touch.png">').when(k % 4 == 2, small + large).otherwise("")
    page = F.concat(F.lit("<head>"), head, F.lit("</head><body>"), said, F.lit("</body>"))
    return dealt(spark, sf_dir, "supplier").select("s_suppkey", P.nothing_listed(page).alias("notice"), H.page_image(page).alias("image"))
