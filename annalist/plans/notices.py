"""Notices, receipts, campaigns and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import coverage, maps, notices
from annalist.plans.base import at, query, shape, table


@query("""
WITH b AS (SELECT page_id, url, rtrim(split_part(split_part(url, '?', 1), '#', 1), '/') AS bare FROM pages)
SELECT page_id, url FROM b WHERE bare NOT IN (SELECT bare FROM b WHERE page_id % 25 = 0)""")
def notice_predicate(spark, sf_dir):
    """Targets that are no section of their source."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    body = F.concat(F.lit('[{"url": "'), notices.bare_url(F.col("url")), F.lit('/"}]'))
    return notices.without_containers(pages, pages.where("page_id % 25 = 0").select(body.alias("sections")), "sections")


@query("""
WITH n AS (SELECT l_orderkey % 20 AS listing, l_linenumber AS page, l_partkey AS notice_id, l_orderkey AS seen FROM lineitem)
SELECT listing, notice_id, max(page)::INTEGER AS page FROM n GROUP BY 1, 2""")
def listed_notices(spark, sf_dir):
    """Notices of paged registers, each once."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 20 AS listing", "l_linenumber AS page", "named_struct('notice_id', l_partkey, 'seen', l_orderkey) AS notice")
    pages = rows.groupBy("listing", "page").agg(F.array_sort(F.collect_list("notice")).alias("notices"))
    return notices.listed(pages, "notice_id", 10).select("listing", "notice_id", F.col("page").cast("int").alias("page"))


@query("""
WITH r AS (SELECT o_orderkey AS receipt_id, o_custkey % 50 AS candidate_id FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' AND
  (SELECT bool_and(l_shipdate <= TIMESTAMP '1997-01-01') FROM lineitem WHERE l_orderkey = o_orderkey)),
n AS (SELECT *, row_number() OVER w AS n, lead(receipt_id) OVER w IS NOT NULL AS f FROM r WINDOW w AS (PARTITION BY candidate_id ORDER BY receipt_id))
SELECT receipt_id, candidate_id, n = 5 AND f AS more FROM n WHERE n <= 5""")
def visible_receipts(spark, sf_dir):
    """Receipts of verification at a time of knowledge."""
    receipts = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS receipt_id", "o_custkey % 50 AS candidate_id", "o_orderdate AS recorded_at")
    evidence = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS receipt_id", "l_shipdate AS acquired_at")
    return notices.visible_receipts(receipts, evidence, at("1997-01-01"), 5).select("receipt_id", "candidate_id", "more")


@query("""
WITH l AS (SELECT version_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY acquired_at DESC, version_id DESC) AS n FROM versions) WHERE n = 1)
SELECT count(*) AS total, count(*) FILTER (WHERE version_id NOT IN (SELECT run_id FROM attempts WHERE stage = 'O')) AS unclassified, count(*) FILTER (WHERE version_id NOT IN (SELECT run_id FROM attempts WHERE stage = 'F')) AS unextracted FROM l""", "versions attempts")
def daily_counts(spark, sf_dir):
    """Documents of a daily report."""
    runs = shape(spark, sf_dir, "attempts").withColumnRenamed("run_id", "version_id")
    return notices.daily_counts(shape(spark, sf_dir, "versions"), runs.where("stage = 'O'"), runs.where("stage = 'F'"))


@query("""
WITH r AS (SELECT user_id AS source_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > count(*) * 0.22 THEN 'failing' ELSE '' END AS issues, 'p' || user_id % 7 AS product FROM events GROUP BY user_id),
m AS (SELECT count(*) AS n FROM generate_series(0, 9) AS t(i) WHERE 'p' || i NOT IN (SELECT product FROM r))
SELECT open_issues, CASE WHEN open_issues > 0 THEN 'extended' ELSE 'complete' END AS status FROM (SELECT (SELECT n FROM m) + (SELECT count(*) FROM r WHERE issues <> '') AS open_issues)""")
def campaign_status(spark, sf_dir):
    """Whether a campaign of observation is complete."""
    failing = F.count_if(F.col("event_type") == "error") > F.count("*") * 0.22
    reports = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.when(failing, "failing").otherwise("").alias("issues"))
    reports = reports.withColumn("product", F.concat(F.lit("p"), F.col("source_id") % 7))
    products = spark.range(10).select(F.concat(F.lit("p"), "id").alias("product"))
    return coverage.campaign(reports, products, F.lit(True)).select("open_issues", "status")


LEVELS = {"yellow": (255, 255, 0), "orange": (255, 165, 0), "red": (255, 0, 0)}


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, 255 - l_linenumber % 8 AS r, CASE l_returnflag WHEN 'A' THEN 255 WHEN 'N' THEN 165 ELSE 0 END - CAST(l_suppkey % 3 AS INTEGER) AS g, CAST(l_partkey % 6 AS INTEGER) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(r - 255) <= 4 AND abs(b) <= 4 THEN CASE WHEN abs(g - 255) <= 4 THEN 'yellow' WHEN abs(g - 165) <= 4 THEN 'orange' WHEN abs(g) <= 4 THEN 'red' END END AS level FROM c""")
def colour_levels(spark, sf_dir):
    """Levels by the colour of a fill."""
    green = F.when(F.col("l_returnflag") == "A", 255).when(F.col("l_returnflag") == "N", 165).otherwise(0) - (F.col("l_suppkey") % 3).cast("int")
    level = maps.level_of_colour(F.lit(255) - F.col("l_linenumber") % 8, green, (F.col("l_partkey") % 6).cast("int"), LEVELS)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", level.alias("level"))


@query("""
WITH a AS (SELECT l_orderkey AS zone, l_linenumber % 2 AS risk, l_returnflag AS level, l_linestatus = 'O' AS t FROM lineitem WHERE l_linenumber <= 2)
SELECT zone, risk, CASE WHEN min(level) <> max(level) THEN 'conflict' WHEN bool_or(t) AND bool_or(NOT t) THEN 'confirmed' WHEN bool_or(t) THEN 'table_only' ELSE 'map_only' END AS state, CASE WHEN min(level) = max(level) THEN min(level) END AS level FROM a GROUP BY 1, 2""")
def merged_levels(spark, sf_dir):
    """Levels of a table and of a map put together."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").selectExpr("l_orderkey AS zone", "l_linenumber % 2 AS risk", "l_returnflag AS level", "l_linestatus")
    return maps.merged_levels(rows.where("l_linestatus = 'O'"), rows.where("l_linestatus <> 'O'"), ["zone", "risk"])


@query("""
SELECT c_custkey AS label, CASE WHEN c_nationkey < 24 THEN CASE WHEN c_acctbal >= 0 AND c_acctbal < 5000 THEN 0 WHEN c_acctbal >= 5000 AND c_acctbal < 9000 THEN 1 END END::BIGINT AS polygon FROM customer""")
def labelled_zones(spark, sf_dir):
    """Zones by the polygon that their label lies in; left and lower edges belong to a polygon, others do not."""
    rows = table(spark, sf_dir, "customer")
    labels = rows.selectExpr("c_custkey % 40 AS map_id", "CAST(c_custkey AS STRING) AS label", "c_acctbal AS x", "CAST(c_nationkey AS DOUBLE) AS y")
    box = lambda a, b: f"array(named_struct('x', {a}.0D, 'y', 0.0D), named_struct('x', {b}.0D, 'y', 0.0D), named_struct('x', {b}.0D, 'y', 24.0D), named_struct('x', {a}.0D, 'y', 24.0D))"
    drawn = spark.range(40).selectExpr("id AS map_id", f"explode(array(named_struct('polygon', 0L, 'points', {box(0, 5000)}), named_struct('polygon', 1L, 'points', {box(5000, 9000)}))) AS p").select("map_id", "p.*")
    return maps.labelled_zones(labels, drawn).select(F.col("label").cast("long").alias("label"), "polygon")
