"""Admission, review, recovery and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import governance
from annalist.plans.base import at, query, shape, table


@query("""
WITH r AS (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 5 = 0 ELSE c_custkey % 5 > 1 END AS fits FROM customer),
i AS (SELECT c_custkey, concat_ws(',', CASE WHEN NOT c_acctbal > 0 THEN 'pending_legal' END, CASE WHEN c_custkey % 3 = 0 THEN 'pending_limits' END, CASE WHEN NOT c_nationkey > 5 THEN 'pending_samples' END, CASE WHEN NOT fits THEN 'coverage' END) AS issues FROM r)
SELECT c_custkey, issues, CASE WHEN issues = '' THEN 'verified' ELSE 'pending' END AS state FROM i""")
def acceptance_review(spark, sf_dir):
    """Reviews with open checks and coverage that does not fit."""
    key = F.col("c_custkey")
    limits = F.when(key % 5 == 0, F.array().cast("array<string>")).when(key % 5 == 1, F.array(F.lit(" "))).otherwise(F.array(F.lit("x")))
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") > 0).alias("legal"), (F.col("c_nationkey") > 5).alias("samples"), (key % 3 != 0).alias("limits"),
        F.when(key % 4 == 0, "declared").otherwise("limited").alias("coverage"), limits.alias("limitations"),
    )
    found = governance.acceptance_review(rows, ["legal", "samples", "limits"])
    return found.select("c_custkey", F.array_join("issues", ",").alias("issues"), "state")


@query("""
WITH p AS (SELECT page_id, url, CASE WHEN page_id % 9 <> 0 THEN md5(html) END AS object_hash, md5(html) AS h FROM pages)
SELECT page_id, NOT EXISTS (SELECT 1 FROM p d WHERE d.page_id % 10 = 0 AND d.url = p.url AND CASE WHEN d.page_id % 20 = 0 THEN d.h ELSE 'other' END = p.object_hash) AS eligible FROM p""")
def inference_eligibility(spark, sf_dir):
    """Resources that are no known decoration."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("h"))
    known = rows.where("page_id % 10 = 0").select("url", F.when(F.col("page_id") % 20 == 0, F.col("h")).otherwise("other").alias("object_hash"))
    return governance.eligible(rows.withColumn("object_hash", F.when(F.col("page_id") % 9 != 0, F.col("h"))), known).select("page_id", "eligible")


@query("""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, (host IN ('example.com', 'example.org') OR host LIKE '%.example.com' OR host LIKE '%.example.org') AND path LIKE '/fr%' AND lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) IN ('', 'pdf') AS allowed FROM p""")
def attachment_policy(spark, sf_dir):
    """Attachments by host, prefix and extension."""
    return table(spark, sf_dir, "pages").select("page_id", governance.attachment_allowed(F.col("url"), ["example.com", "example.org"], "/fr", ["pdf"]).alias("allowed"))


@query("""
SELECT conv_id, max(turn) - min(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AND count(*) <= 500 AND bool_and(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 20 AND NOT regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFD}]')) AS accepted,
  count(*) AS pages FROM conversations GROUP BY conv_id""")
def text_layer(spark, sf_dir):
    """Documents whose text layer can be used."""
    return governance.text_layer(table(spark, sf_dir, "conversations").withColumnRenamed("turn", "page"), "conv_id")


@query("""
SELECT o_orderkey AS target_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'excluded' WHEN o_orderdate < listed THEN 'withdrawn' ELSE 'blocking' END AS state
FROM orders o LEFT JOIN (SELECT o_custkey % 25 AS source_id, max(o_orderdate) AS listed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) l ON l.source_id = o.o_custkey % 25 WHERE o_totalprice > 300000""")
def unavailable_targets(spark, sf_dir):
    """Targets that cannot be had, by why."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS target_id", "o_custkey % 25 AS source_id", "o_orderdate AS last_seen_at", "o_orderpriority = '5-LOW' AS excluded", "o_totalprice", "o_orderstatus")
    listings = rows.where("o_orderstatus = 'F'").select("source_id", F.col("last_seen_at").alias("listed_at"))
    return governance.unavailable(rows.where("o_totalprice > 300000"), listings).select("target_id", "state")


@query("SELECT count(*) AS scanned, count(*) FILTER (WHERE fingerprint IS NOT NULL AND version_id % 3 <> 0) AS written, count(*) FILTER (WHERE fingerprint IS NULL AND version_id % 3 <> 0) AS not_reusable, count(*) FILTER (WHERE version_id % 3 = 0) AS stored FROM versions", "versions")
def equivalence_backfill(spark, sf_dir):
    """Counts of a backfill of fingerprints."""
    versions = shape(spark, sf_dir, "versions")
    return governance.backfill(versions, versions.where("version_id % 3 = 0").select("version_id"))[1]


@query("""
SELECT version_id FROM versions v WHERE NOT interpreted AND (SELECT max_by(l_returnflag, (l_shipdate, l_linenumber)) FROM lineitem WHERE l_orderkey = v.version_id) <> 'R'""", "versions")
def archived_versions(spark, sf_dir):
    """Pending versions that are archived and were not recovered since."""
    log = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS version_id", "l_shipdate AS at", "l_linenumber AS id", "CASE WHEN l_returnflag = 'R' THEN 'recover' ELSE 'archive' END AS action")
    return governance.archived(shape(spark, sf_dir, "versions").where("NOT interpreted"), log, "version_id").select("version_id")


@query("""
WITH o AS (SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30'), g AS (SELECT max_by(o_orderstatus <> 'P', (o_orderdate, o_orderkey)) AS enabled FROM o),
s AS (SELECT o_custkey % 40 AS source_id, max_by(o_totalprice > 100000, (o_orderdate, o_orderkey)) AS enabled FROM o GROUP BY 1)
SELECT job_id, (SELECT enabled FROM g) AND coalesce(s.enabled, true) AS admitted FROM jobs LEFT JOIN s ON s.source_id = jobs.source_id WHERE queue = 'view'""", "jobs")
def embedding_admission(spark, sf_dir):
    """Jobs that a global switch and one of their source let run."""
    orders = table(spark, sf_dir, "orders")
    switches = orders.selectExpr("o_orderdate AS at", "o_orderkey AS id", "o_orderstatus <> 'P' AS enabled")
    own = orders.selectExpr("o_custkey % 40 AS source_id", "o_orderdate AS at", "o_orderkey AS id", "o_totalprice > 100000 AS enabled")
    return governance.admitted(shape(spark, sf_dir, "jobs").where("queue = 'view'"), switches, own, at("1998-06-30")).select("job_id", "admitted")


@query("""
WITH w AS (SELECT l_orderkey AS page, l_quantity AS y, l_extendedprice AS x, 'w' || l_partkey AS word FROM lineitem),
j AS (SELECT *, CASE WHEN y - lag(y) OVER o <= 1 THEN 0 ELSE 1 END AS new FROM w WINDOW o AS (PARTITION BY page ORDER BY y, x, word)),
l AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y, x, word ROWS UNBOUNDED PRECEDING) AS line FROM j)
SELECT page, line::BIGINT AS line, string_agg(word, ' ' ORDER BY x, y, word) AS text FROM l GROUP BY 1, 2""")
def word_lines(spark, sf_dir):
    """Positioned words put together to lines."""
    words = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_quantity AS y", "l_extendedprice AS x", "'w' || l_partkey AS word")
    return governance.lines_of_words(words, ["page"])


@query("SELECT l_orderkey AS map_id, count(DISTINCT l_linenumber) AS facts, count(DISTINCT l_linenumber) = 4 AND count(*) = 4 AS complete FROM lineitem GROUP BY 1")
def map_completeness(spark, sf_dir):
    """Maps that have every part exactly once."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("map_id"), "l_linenumber")
    return governance.complete_maps(rows, ["map_id"], ["l_linenumber"], 4)


@query("""
SELECT * FROM (SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) AS incidents FROM orders), (SELECT count(*) FILTER (WHERE event_type <> 'click') AS pending, count(*) AS messages FROM events)""")
def incident_report(spark, sf_dir):
    """Counts of incidents and messages."""
    incidents = table(spark, sf_dir, "orders").selectExpr("CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS recovered_at")
    messages = table(spark, sf_dir, "events").selectExpr("event_id AS id", "ts AS at", "event_type = 'click' AS sent")
    return governance.incident_report(incidents, messages)[0]


@query("""
SELECT user_id, count(*) AS runs, max(ts) AS last_started, max(ts) + INTERVAL 1 DAY AS next_due, max(ts) + INTERVAL 1 DAY <= TIMESTAMP '2024-01-20' AS due FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND event_type = 'signup' GROUP BY 1""")
def backup_report(spark, sf_dir):
    """When the next backup of each scope is due."""
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'").withColumnRenamed("ts", "started_at")
    return governance.backup_due(rows, "user_id", 24 * 3600, at("2024-01-20"))


@query("""
WITH r AS (SELECT l_orderkey AS version_id, concat_ws(chr(0), 'u' || l_partkey, l_returnflag, CASE WHEN l_tax = 0 THEN '' ELSE 'h' || l_suppkey END) AS line, l_tax > 0 OR l_discount > 0.05 AS whole FROM lineitem)
SELECT version_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS identity, bool_and(whole) AS complete FROM r GROUP BY 1""")
def content_identity(spark, sf_dir):
    """Identity of versions by their resources."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS version_id", "'u' || l_partkey AS url", "l_returnflag AS role", "CASE WHEN l_tax <> 0 THEN 'h' || l_suppkey END AS object_hash", "l_discount <= 0.05 AS required")
    return governance.content_identity(rows, ["version_id"])


@query("SELECT l_orderkey AS comparison_id, coalesce(string_agg('d' || l_linenumber, ',' ORDER BY l_linenumber), '') = 'd1,d2,d3,d4' AND bool_and(l_tax <> 0) AS valid FROM lineitem GROUP BY 1")
def comparison_validation(spark, sf_dir):
    """Comparisons that name each dimension once, with evidence (Q41)."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS comparison_id", "'d' || l_linenumber AS dimension", "CASE WHEN l_tax = 0 THEN ' ' ELSE 'e' END AS evidence")
    return governance.complete_comparisons(rows, "comparison_id", ["d1", "d2", "d3", "d4"])


@query("""
SELECT sha256('kind=' || event_type || '&source=' || (user_id % 5)) AS request_hash, min(ts) AS created_at, count(*) AS requests, min(ts) + INTERVAL 900 SECOND AS expires_at FROM events GROUP BY 1""")
def saved_views(spark, sf_dir):
    """Requests by the hash of what they ask (Q33)."""
    rows = table(spark, sf_dir, "events").selectExpr("concat(' ', upper(event_type)) AS kind", "user_id % 5 AS source", "ts AS at")
    return governance.saved_views(rows, ["source", "kind"], 900)


@query("""
WITH t AS (SELECT o_orderkey AS target_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS fetched_at, CASE WHEN o_totalprice > 300000 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate - INTERVAL 1 DAY END AS listed_at, o_orderpriority = '1-URGENT' AS failed FROM orders)
SELECT target_id, CASE WHEN fetched_at IS NULL THEN 'never_fetched' WHEN listed_at > fetched_at THEN 'changed_listing' WHEN failed AND date_sub('second', fetched_at, TIMESTAMP '1998-06-30') >= 324000 THEN 'retry'
  WHEN date_sub('second', fetched_at, TIMESTAMP '1998-06-30') >= 7776000 THEN 'stale' END AS reason FROM t""")
def recheck_plan(spark, sf_dir):
    """Why targets are fetched again (Q37)."""
    day = "INTERVAL 1 DAY"
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS target_id", "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS fetched_at", f"CASE WHEN o_totalprice > 300000 THEN o_orderdate + {day} ELSE o_orderdate - {day} END AS listed_at", "o_orderpriority = '1-URGENT' AS failed")
    return governance.recheck_plan(rows, at("1998-06-30"), 90 * 24 * 3600).select("target_id", "reason")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY workload, price_version_id ORDER BY at DESC, id DESC) AS n FROM attempts WHERE outcome <> 'deferred')
SELECT workload, price_version_id, CASE WHEN count(*) = 3 AND bool_and(outcome = 'failed') THEN 'fallback' ELSE 'primary' END AS route FROM r WHERE n <= 3 GROUP BY 1, 2""", "attempts")
def provider_route(spark, sf_dir):
    """The provider to use after failures."""
    return governance.fallback_route(shape(spark, sf_dir, "attempts"), ["workload", "price_version_id"], 3)


@query("""
WITH f AS (SELECT job_id, version_id, row_number() OVER (PARTITION BY version_id ORDER BY completed_at, job_id) AS n FROM jobs WHERE state = 'failed' AND completed_at <= TIMESTAMP '2024-01-25'),
r AS (SELECT version_id, count(*) AS running FROM jobs WHERE state = 'running' GROUP BY 1)
SELECT job_id FROM f LEFT JOIN r ON r.version_id = f.version_id WHERE n <= 25 - coalesce(running, 0)""", "jobs")
def recovery_admission(spark, sf_dir):
    """Failed jobs that may run again beside those that run."""
    return governance.recovery_admission(shape(spark, sf_dir, "jobs"), ["version_id"], at("2024-01-25"), 25).select("job_id")


@query("""
WITH l AS (SELECT event_id AS id, event_id % 50 AS artifact, ts AS "at", event_type = 'purchase' AS finished FROM events WHERE ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-20' OR event_type = 'purchase'),
p AS (SELECT *, row_number() OVER w AS n, first_value(id) OVER w AS leader, first_value(finished) OVER w AS ready FROM l WINDOW w AS (PARTITION BY artifact ORDER BY finished DESC, "at", id))
SELECT id, leader, CASE WHEN ready AND n > 1 THEN 'reuses' WHEN n = 1 THEN 'leads' ELSE 'waits' END AS role FROM p""")
def artifact_flight(spark, sf_dir):
    """Requests for one artifact: one leads, the rest wait or reuse."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS id", "event_id % 50 AS artifact", "ts AS at", "ts + INTERVAL 1 HOUR AS lease_expires_at", "event_type = 'purchase' AS finished")
    return governance.single_flight(rows, "artifact", at("2024-01-20")).select("id", "leader", "role")


@query("""
WITH c AS (SELECT workload, stage, price_version_id, max_by(id, (at, id)) AS checkpoint_id FROM attempts WHERE outcome = 'succeeded' AND at < TIMESTAMP '1996-01-01' GROUP BY 1, 2, 3)
SELECT a.id, checkpoint_id FROM attempts a LEFT JOIN c ON c.workload = a.workload AND c.stage = a.stage AND c.price_version_id = a.price_version_id""", "attempts")
def checkpoint_reuse(spark, sf_dir):
    """Segments with the checkpoint they can take over."""
    rows, keys = shape(spark, sf_dir, "attempts"), ["workload", "stage", "price_version_id"]
    done = rows.where((F.col("outcome") == "succeeded") & (F.col("at") < at("1996-01-01")))
    return governance.checkpoint_reuse(rows.select("id", *keys), done.select("id", "at", *keys), keys).select("id", "checkpoint_id")


@query("""
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS request_hash, CASE WHEN length(text) > 1000 THEN 'relevant' ELSE 'irrelevant' END AS decision FROM documents WHERE text IS NOT NULL),
c AS (SELECT sha256(text) AS request_hash, max(CASE WHEN length(text) > 1500 THEN 'relevant' ELSE 'irrelevant' END) AS now FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT doc_id, CASE WHEN now IS NULL THEN 'request_missing' WHEN now = decision THEN 'same' ELSE 'changed' END AS outcome FROM r LEFT JOIN c USING (request_hash)""")
def classification_review(spark, sf_dir):
    """Recorded decisions against those made now for requests of the same hash."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    decided = lambda n: F.when(F.length("text") > n, "relevant").otherwise("irrelevant")
    hashed = F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)
    recorded = rows.select("doc_id", hashed.alias("request_hash"), decided(1000).alias("decision"))
    current = rows.select(F.sha2("text", 256).alias("request_hash"), decided(1500).alias("decision"))
    return governance.reviewed_decisions(recorded, current).select("doc_id", "outcome")


_PIPELINE = ["acquisition", "ocr", "classification", "extraction", "embedding", "linking"]
_STAGE = "CASE l_linenumber " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_PIPELINE, 1)) + " END"
_RUN = "CASE WHEN l_discount > 0.08 THEN 'failed' WHEN l_tax > 0.07 THEN 'running' ELSE 'succeeded' END"
_BEST = ", ".join(f"coalesce(max(CASE WHEN stage = '{s}' THEN CASE outcome WHEN 'succeeded' THEN 3 WHEN 'running' THEN 2 ELSE 1 END END), 0) AS s{i}" for i, s in enumerate(_PIPELINE))
_FIRST = " ".join(f"WHEN s{i} < 3 THEN {i}" for i in range(len(_PIPELINE)))


@query(f"""
WITH r AS (SELECT l_orderkey AS version_id, {_STAGE} AS stage, {_RUN} AS outcome FROM lineitem), b AS (SELECT version_id, {_BEST} FROM r GROUP BY 1), f AS (SELECT *, CASE {_FIRST} END AS i FROM b)
SELECT version_id, [{', '.join(f"'{s}'" for s in _PIPELINE)}][i + 1] AS stage, CASE WHEN i IS NULL THEN 'done' ELSE CASE [{', '.join(f's{i}' for i in range(len(_PIPELINE)))}][i + 1] WHEN 2 THEN 'running' WHEN 1 THEN 'blocked' ELSE 'due' END END AS state FROM f""")
def stage_handoff(spark, sf_dir):
    """The stage that each version is handed to next."""
    runs = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS version_id", f"{_STAGE} AS stage", f"{_RUN} AS outcome")
    return governance.next_stages(runs, _PIPELINE)
