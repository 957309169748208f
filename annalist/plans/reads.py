"""Filters, joins, as-of reads, set operations, pages and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import asof, intervals, lineage, paging, reports
from annalist.plans.base import at, query, shape, table


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
  FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30') WHERE n = 1""")
def measures_asof(spark, sf_dir):
    """Latest version of each document known at the cutoff."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") <= at("1998-06-30"))
    return asof.latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")


@query("""
SELECT c_custkey, c_name, o_orderkey, o_orderdate FROM customer LEFT JOIN LATERAL (
  SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON true""")
def latest_lateral(spark, sf_dir):
    """Latest row per outer row, kept where there is none."""
    rows = asof.with_latest(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", ["o_orderdate", "o_orderkey"])
    return rows.select("c_custkey", "c_name", "o_orderkey", "o_orderdate")


@query("""
SELECT version_id, document_id FROM versions v WHERE NOT EXISTS (
  SELECT 1 FROM versions w WHERE w.document_id = v.document_id AND w.fingerprint = v.fingerprint AND (w.acquired_at, w.version_id) > (v.acquired_at, v.version_id))""", "versions")
def superseded_anti_join(spark, sf_dir):
    """Versions that no later one of their class replaces."""
    rows = asof.replaced_by_later(shape(spark, sf_dir, "versions"), ["document_id", "fingerprint"], ["acquired_at", "version_id"], F.lit(True))
    return rows.where(~F.col("replaced") | F.col("fingerprint").isNull()).select("version_id", "document_id")


@query("""
SELECT e.event_id, e.user_id, v.event_id AS view_id, v.ts AS view_ts FROM events e LEFT JOIN LATERAL (
  SELECT event_id, ts FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND v.ts <= e.ts ORDER BY ts DESC, event_id DESC LIMIT 1) v ON true
WHERE e.event_type = 'purchase'""")
def asof_event_join(spark, sf_dir):
    """Each purchase with the last view of its user at or before it."""
    events = table(spark, sf_dir, "events")
    left, right = events.where("event_type = 'purchase'"), events.where("event_type = 'view'")
    joined = asof.as_of_join(left, right, ["user_id"], "ts", "ts", ["event_id"], {"event_id": "view_id", "ts": "view_ts"})
    return joined.select("event_id", "user_id", "view_id", "view_ts")


@query("""
SELECT priority, version_id AS selected, acquired_at AS selected_at FROM (
  SELECT *, row_number() OVER (PARTITION BY priority ORDER BY acquired_at DESC, version_id DESC) AS n FROM versions WHERE acquired_at <= TIMESTAMP '1997-01-01') WHERE n = 1""", "versions")
def dataset_selected_at(spark, sf_dir):
    """What a selection log had chosen at a time."""
    return asof.selected_at(shape(spark, sf_dir, "versions"), "priority", "version_id", "acquired_at", "version_id", at("1997-01-01"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def optional_filter(spark, sf_dir):
    """Filters with values that may be unset."""
    orders = table(spark, sf_dir, "orders")
    return paging.optional(orders, o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"], o_custkey=None).select("o_orderkey", "o_orderstatus")


@query("SELECT c_nationkey, c_custkey, c_name FROM customer WHERE (c_nationkey, c_custkey) > (7, 100) ORDER BY c_nationkey, c_custkey LIMIT 25")
def row_value_keyset(spark, sf_dir):
    """The next page behind a key."""
    rows = table(spark, sf_dir, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("long"))
    page = paging.keyset_page(rows.select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey", "c_custkey"], (7, 100), 25)
    return page.withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-01-01', 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def descending_keyset(spark, sf_dir):
    """A page of a log read backwards."""
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    place, limit = F.struct("o_orderdate", "o_orderkey"), F.struct(at("1998-01-01").alias("o_orderdate"), F.lit(500).cast("long").alias("o_orderkey"))
    return paging.keyset_page(orders.where(place < limit), ["o_orderdate", "o_orderkey"], None, 30, descending=True).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer) > 60 AS more FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def offset_page(spark, sf_dir):
    """A page and whether more follows."""
    return paging.offset_page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), [F.col("c_name"), F.col("c_custkey")], 20, 2)


@query("""
SELECT c_custkey, o_orderkey, o_orderstatus IS NOT DISTINCT FROM CASE WHEN c_acctbal > 0 THEN 'F' END AS same
FROM customer LEFT JOIN orders ON o_custkey = c_custkey""")
def null_safe_compare(spark, sf_dir):
    """Comparison in which null equals null."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("c_custkey", "o_orderkey", F.col("o_orderstatus").eqNullSafe(F.when(F.col("c_acctbal") > 0, "F")).alias("same"))


@query("""
SELECT job_id, CASE WHEN state = 'running' AND lease_expires_at <= TIMESTAMP '2024-01-16' THEN 'expired' WHEN state = 'failed' AND attempt_count >= 2 THEN 'exhausted'
  WHEN state = 'pending' AND available_at > TIMESTAMP '2024-01-16' THEN 'scheduled' ELSE state END AS shown FROM jobs""", "jobs")
def case_ladder(spark, sf_dir):
    """A ladder of states (P10)."""
    state, now = F.col("state"), at("2024-01-16")
    shown = (
        F.when((state == "running") & (F.col("lease_expires_at") <= now), "expired").when((state == "failed") & (F.col("attempt_count") >= 2), "exhausted")
        .when((state == "pending") & (F.col("available_at") > now), "scheduled").otherwise(state)
    )
    return shape(spark, sf_dir, "jobs").select("job_id", shown.alias("shown"))


@query("""
SELECT DISTINCT source_id, least(TIMESTAMP '1998-06-30', (SELECT min(suspended_at) FROM suspensions s WHERE s.source_id = v.source_id
  AND suspended_at <= TIMESTAMP '1998-06-30' AND (resumed_at IS NULL OR resumed_at > TIMESTAMP '1998-06-30'))) AS cutoff FROM versions v""", "versions suspensions")
def least_cutoff(spark, sf_dir):
    """To when facts of a source may be read."""
    frozen = asof.cutoffs(shape(spark, sf_dir, "suspensions"), at("1998-06-30"))
    rows = shape(spark, sf_dir, "versions").select("source_id").distinct().join(frozen, "source_id", "left")
    return rows.select("source_id", F.least(at("1998-06-30"), F.col("_frozen")).alias("cutoff"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_filter(spark, sf_dir):
    """EXISTS and IN as semi joins."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return table(spark, sf_dir, "orders").join(returned, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_filter(spark, sf_dir):
    """NOT IN on a key without nulls."""
    partial = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(partial, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
SELECT o_orderkey, count(l_orderkey) AS late FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY GROUP BY o_orderkey""")
def left_range_on(spark, sf_dir):
    """An outer join with a range in its condition."""
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAY"))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), on, "left")
    return rows.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("late"))


@query("SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 1000 GROUP BY n_name, r_name")
def dimension_chain(spark, sf_dir):
    """Inner joins along dimensions, with a parameter."""
    params = {"least": 1000}
    rows = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > F.lit(params["least"]))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@query("SELECT event_id, user_id, (props ->> '$.k')::BIGINT AS k, c_name FROM events LEFT JOIN customer ON c_custkey::VARCHAR = (props ->> '$.k')")
def text_cast_key(spark, sf_dir):
    """A join key read from JSON text."""
    events = table(spark, sf_dir, "events").withColumn("_key", F.get_json_object("props", "$.k"))
    rows = events.join(table(spark, sf_dir, "customer"), F.col("_key") == F.col("c_custkey").cast("string"), "left")
    return rows.select("event_id", "user_id", F.col("_key").cast("long").alias("k"), "c_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE strpos(lower(n_name), lower('an')) > 0")
def substring_search(spark, sf_dir):
    """A part of a name, in any case."""
    return table(spark, sf_dir, "nation").where(F.instr(F.lower("n_name"), "an") > 0).select("n_nationkey", "n_name")


@query("SELECT doc_id, regexp_matches(coalesce(source, ''), '^src[0-9]+$') AS well_formed, text LIKE 'T%' AS begins_with_t FROM documents")
def regex_check(spark, sf_dir):
    """Patterns on columns."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).rlike("^src[0-9]+$").alias("well_formed"), F.col("text").like("T%").alias("begins_with_t"))


@query("""
SELECT job_id, state FROM jobs WHERE (state = 'running') <> (lease_expires_at IS NOT NULL) OR (state IN ('succeeded', 'failed')) <> (completed_at IS NOT NULL)
  OR (state = 'failed' AND error_code IS NULL) OR attempt_count > max_attempts""", "jobs")
def invariant_violations(spark, sf_dir):
    """Rows that break the invariants of a table."""
    from annalist.functions.checks import JOBS, violations

    return violations(shape(spark, sf_dir, "jobs"), JOBS).select("job_id", "state")


@query("SELECT o_orderkey, o_orderstatus, list_position(['P', 'F', 'O'], o_orderstatus)::INTEGER AS place FROM orders ORDER BY place, o_totalprice DESC, o_orderkey LIMIT 50")
def custom_rank_order(spark, sf_dir):
    """A fixed order of states, then a value, then the key."""
    place = F.array_position(F.array(*map(F.lit, "PFO")), F.col("o_orderstatus")).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", place.alias("place")).orderBy("place", F.desc("o_totalprice"), "o_orderkey").limit(50).drop("o_totalprice")


@query("""
SELECT c_custkey, last_order FROM (SELECT c_custkey, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
ORDER BY last_order DESC NULLS LAST, c_custkey LIMIT 40""")
def nulls_last(spark, sf_dir):
    """Where nulls go is said."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("c_custkey").agg(F.max("o_orderdate").alias("last_order")).orderBy(F.col("last_order").desc_nulls_last(), "c_custkey").limit(40)


@query("SELECT l_orderkey, l_linenumber, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)::INTEGER AS ordinal FROM lineitem) WHERE ordinal <= 3")
def capped_per_group(spark, sf_dir):
    """At most three rows of each group, with their place."""
    return asof.first_n(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], 3).select("l_orderkey", "l_linenumber", "ordinal")


@query("""
SELECT o_custkey, list_transform(list_slice(list(o_orderkey ORDER BY o_orderkey), 3, 5), lambda x: x::VARCHAR).array_to_string(',') AS page, count(*) > 5 AS more FROM orders GROUP BY o_custkey""")
def sliced_lists(spark, sf_dir):
    """A page of each list of a nested result."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("_all"))
    return rows.select("o_custkey", F.array_join(F.slice("_all", 3, 3).cast("array<string>"), ",").alias("page"), (F.size("_all") > 5).alias("more"))


@query("""
SELECT 'order' AS kind, o_orderkey::VARCHAR AS subject, o_orderdate AS since FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'late', l_orderkey::VARCHAR, l_shipdate FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-11-01'
UNION ALL SELECT 'error', event_id::VARCHAR, ts FROM events WHERE event_type = 'error'""")
def findings_union(spark, sf_dir):
    """One list of findings from unlike tables."""
    part = lambda name, kind, key, when, where: table(spark, sf_dir, name).where(where).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("subject"), F.col(when).alias("since"))
    late = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") > at("1998-11-01")).select(F.lit("late").alias("kind"), F.col("l_orderkey").cast("string").alias("subject"), F.col("l_shipdate").alias("since"))
    return reports.combined(part("orders", "order", "o_orderkey", "o_orderdate", "o_orderstatus = 'P'"), late, part("events", "error", "event_id", "ts", "event_type = 'error'"))


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def distinct_union(spark, sf_dir):
    """Distinct ids of two sets."""
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return a.union(table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


LINEAGE = """
p AS (SELECT version_id, lag(version_id) OVER (PARTITION BY document_id, fingerprint ORDER BY version_id) AS original FROM versions WHERE fingerprint IS NOT NULL)"""


@query(f"""
WITH RECURSIVE {LINEAGE}, r AS (
  SELECT version_id, version_id AS root, 0 AS depth FROM p WHERE original IS NULL UNION ALL SELECT p.version_id, r.root, r.depth + 1 FROM p JOIN r ON p.original = r.version_id)
SELECT version_id, root, depth FROM r""", "versions")
def lineage_roots(spark, sf_dir):
    """The first of each chain of reused versions, in rounds that double the jump."""
    return lineage.roots(_parents(spark, sf_dir), "version_id", "original")


@query(f"""
WITH RECURSIVE {LINEAGE}, r AS (
  SELECT version_id FROM versions WHERE status = 'P' UNION SELECT p.original FROM p JOIN r ON p.version_id = r.version_id WHERE p.original IS NOT NULL)
SELECT version_id FROM r""", "versions")
def lineage_closure(spark, sf_dir):
    """Survivors and all their ancestors."""
    start = shape(spark, sf_dir, "versions").where("status = 'P'").select("version_id")
    edges = _parents(spark, sf_dir).where("original IS NOT NULL").select(F.col("version_id").alias("run"), "original")
    return lineage.reachable(edges, "run", "original", start)


def _parents(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("document_id", "fingerprint").orderBy("version_id")
    return shape(spark, sf_dir, "versions").where("fingerprint IS NOT NULL").select("version_id", F.lag("version_id").over(order).alias("original"))


@query("SELECT version_id, document_id, status FROM versions v WHERE status IS DISTINCT FROM (SELECT status FROM versions w WHERE w.document_id = v.document_id AND acquired_at <= TIMESTAMP '1998-01-01' ORDER BY acquired_at DESC, version_id DESC LIMIT 1) AND acquired_at > TIMESTAMP '1998-01-01'", "versions")
def insert_if_changed(spark, sf_dir):
    """Rows that say something new about their key."""
    rows = shape(spark, sf_dir, "versions")
    log, incoming = rows.where(F.col("acquired_at") <= at("1998-01-01")), rows.where(F.col("acquired_at") > at("1998-01-01"))
    return asof.insert_if_changed(log, incoming, "document_id", "status", ["acquired_at", "version_id"]).select("version_id", "document_id", "status")


@query("""
SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, coalesce(n.status, o.status) AS status, least(o.seen, n.seen) AS seen FROM
  (SELECT o_custkey, max(o_orderstatus) AS status, min(o_orderdate) AS seen FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1) o FULL JOIN
  (SELECT o_custkey, CASE WHEN max(o_orderstatus) = 'P' THEN NULL ELSE max(o_orderstatus) END AS status, min(o_orderdate) AS seen FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1) n ON o.o_custkey = n.o_custkey""")
def upsert_merge(spark, sf_dir):
    """Insert or update, keeping what is not told anew."""
    from annalist.sources.sinks import merged

    orders = table(spark, sf_dir, "orders")
    part = lambda df: df.groupBy("o_custkey").agg(F.max("o_orderstatus").alias("status"), F.min("o_orderdate").alias("seen"))
    old, new = part(orders.where(F.col("o_orderdate") < at("1997-01-01"))), part(orders.where(F.col("o_orderdate") >= at("1997-01-01")))
    new = new.withColumn("status", F.nullif(F.col("status"), F.lit("P")))
    return merged(old, new, ["o_custkey"], {"seen": F.least("old_seen", "new_seen")})


@query("SELECT * FROM (SELECT source_id, territory, product FROM sources WHERE enabled) s WHERE EXISTS (SELECT 1 FROM acceptances a WHERE a.source_id = s.source_id AND decision = 'accepted')", "sources acceptances")
def public_sources_view(spark, sf_dir):
    """The public view of sources: enabled, and accepted at some time."""
    rows = shape(spark, sf_dir, "sources").where("enabled").select("source_id", "territory", "product")
    return rows.join(shape(spark, sf_dir, "acceptances").where("decision = 'accepted'"), "source_id", "left_semi")


# ---- intervals


@query("""
SELECT user_id, max(gap) AS max_gap_seconds, min(first_at) AS first_at, max(last_at) AS last_at, max(n) AS n FROM (
  SELECT user_id, date_sub('second', p, ts) AS gap, NULL AS first_at, NULL AS last_at, NULL AS n FROM (
    SELECT user_id, ts, coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts), TIMESTAMP '2024-01-01') AS p FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31')
  UNION ALL SELECT user_id, date_sub('second', max(ts), TIMESTAMP '2024-01-31'), min(ts), max(ts), count(*) FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' GROUP BY user_id)
GROUP BY user_id""")
def max_check_gap(spark, sf_dir):
    """The longest silence of each source, both ends counted."""
    return intervals.largest_gap(table(spark, sf_dir, "events"), ["user_id"], "ts", at("2024-01-01"), at("2024-01-31"))


@query("""
WITH s AS (SELECT user_id, ts AS start_at, ts + INTERVAL 2 HOUR AS end_at FROM events WHERE ts < TIMESTAMP '2024-01-11' AND ts + INTERVAL 2 HOUR > TIMESTAMP '2024-01-10'),
c AS (SELECT user_id, greatest(start_at, TIMESTAMP '2024-01-10') AS a, least(end_at, TIMESTAMP '2024-01-11') AS b FROM s),
k AS (SELECT DISTINCT user_id FROM events),
e AS (SELECT user_id, a, b FROM c UNION ALL SELECT user_id, TIMESTAMP '2024-01-11', TIMESTAMP '2024-01-11' FROM k),
g AS (SELECT user_id, coalesce(max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TIMESTAMP '2024-01-10') AS gap_start, a AS gap_end FROM e)
SELECT user_id, gap_start, gap_end FROM g WHERE gap_start < gap_end AND date_sub('second', gap_start, gap_end) > 60""")
def interval_complement(spark, sf_dir):
    """What a day has left beside intervals; a minute or less is dropped."""
    spans = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("start_at"), (F.col("ts") + F.expr("INTERVAL 2 HOUR")).alias("end_at"))
    return intervals.complement(spans, ["user_id"], "start_at", "end_at", at("2024-01-10"), at("2024-01-11"), 60)


@query("""
SELECT a.event_id AS view_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id
  AND a.ts < b.ts + CASE WHEN b.event_id % 40 = 0 THEN INTERVAL 50 DAY ELSE INTERVAL 3 HOUR END AND b.ts < a.ts + CASE WHEN a.event_id % 50 = 0 THEN INTERVAL 60 DAY ELSE INTERVAL 30 HOUR END WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def interval_overlap(spark, sf_dir):
    """Pairs of overlapping intervals of a user, met in day buckets, long ones in months."""
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("a"), F.expr("ts + CASE WHEN event_id % 50 = 0 THEN INTERVAL 1440 HOUR ELSE INTERVAL 30 HOUR END").alias("b"))
    right = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("c"), F.expr("ts + CASE WHEN event_id % 40 = 0 THEN INTERVAL 1200 HOUR ELSE INTERVAL 3 HOUR END").alias("d"))
    return intervals.overlap_join(left, right, ["user_id"], ("a", "b"), ("c", "d")).select("view_id", "click_id")


@query("""
SELECT b.bucket, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 18:00:00', INTERVAL 6 HOUR)) AS bucket) b LEFT JOIN (
  SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS bucket, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1) e ON b.bucket = e.bucket""")
def history_buckets_zero_filled(spark, sf_dir):
    """Counts per fixed step, with the empty ones."""
    sums = [F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")]
    rows = intervals.buckets(table(spark, sf_dir, "events"), "ts", at("2024-01-01"), at("2024-01-31"), 6 * 3600, sums)
    return rows.fillna(0, ["n", "errors"])


@query("""
SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_returnflag WHEN 'R' THEN 'customer' WHEN 'A' THEN 'supplier' ELSE 'part' END AS entity_kind, coalesce(c_nationkey, s_nationkey, p_size) AS source_id
FROM lineitem LEFT JOIN customer ON l_returnflag = 'R' AND c_custkey = l_suppkey LEFT JOIN supplier ON l_returnflag = 'A' AND s_suppkey = l_suppkey LEFT JOIN part ON l_returnflag = 'N' AND p_partkey = l_partkey AND p_size > 10""")
def polymorphic_parents(spark, sf_dir):
    """The owner of entities of several kinds, by one join."""
    from annalist.operators import facts

    kind = F.when(F.col("l_returnflag") == "R", "customer").when(F.col("l_returnflag") == "A", "supplier").otherwise("part")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), kind.alias("entity_kind"), F.when(kind == "part", F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("entity_id"))
    parents = {
        "customer": table(spark, sf_dir, "customer").selectExpr("c_custkey AS entity_id", "c_nationkey AS source_id"),
        "supplier": table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS entity_id", "s_nationkey AS source_id"),
        "part": table(spark, sf_dir, "part").where("p_size > 10").selectExpr("p_partkey AS entity_id", "p_size AS source_id"),
    }
    return facts.owned(rows, parents).select("id", "entity_kind", "source_id")


_PROPS = "CASE WHEN event_id % 3 = 0 THEN '{\"k\": \"\", \"expected\": {\"anchor\": \"\"}}' WHEN event_id % 3 = 1 THEN '{\"expected\": {\"anchor\": \"2024-01-0' || (event_id % 9 + 1) || '\"}}' ELSE props END"


@query(f"""
WITH e AS (SELECT event_id, value, {_PROPS} AS body FROM events)
SELECT event_id, coalesce(CASE WHEN value > 100 THEN 7 END, TRY_CAST(json_extract_string(body, '$.k') AS INTEGER), 600) AS check_seconds, nullif(json_extract_string(body, '$.expected.anchor'), '')::DATE AS anchor FROM e""")
def json_defaults(spark, sf_dir):
    """Settings from an override, else from JSON, else by default; empty strings are none."""
    rows = table(spark, sf_dir, "events").select("event_id", "value", F.expr(_PROPS).alias("body"))
    given = F.get_json_object("body", "$.k").try_cast("int")
    anchor = F.nullif(F.get_json_object("body", "$.expected.anchor"), F.lit("")).try_cast("date")
    return rows.select("event_id", F.coalesce(F.when(F.col("value") > 100, 7), given, F.lit(600)).alias("check_seconds"), anchor.alias("anchor"))


_JSON_KINDS = ["'{\"k\": 1}'", "'[1, 2, 3]'", "'\"text\"'", "'true'", "'[]'"]
_JSON_OF = "CASE event_id % 5 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_JSON_KINDS)) + " END"


@query(f"""
WITH e AS (SELECT event_id, {_JSON_OF} AS body FROM events)
SELECT event_id, CASE json_type(body) WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' END AS kind, CASE WHEN json_type(body) = 'ARRAY' THEN json_array_length(body)::INTEGER END AS n FROM e""")
def json_types(spark, sf_dir):
    """Types of JSON values, and lengths of arrays."""
    body = F.expr(_JSON_OF)
    shown = F.schema_of_variant(F.parse_json(body))
    kind = F.when(F.startswith(shown, F.lit("OBJECT")), "object").when(F.startswith(shown, F.lit("ARRAY")), "array").when(shown == "STRING", "string").when(shown == "BOOLEAN", "boolean")
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), F.json_array_length(body).alias("n"))


@query("""
WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_distinct(ws))::INTEGER AS distinct_words, list_sort(list_distinct(ws))[1] AS first, list_contains(ws, 'and') AS has_and, len(list_filter(list_distinct(ws), lambda x: NOT starts_with(x, 'th')))::INTEGER AS without_prefix FROM w""")
def list_sets(spark, sf_dir):
    """Lists as sets: each once and sorted, membership, deletion by prefix."""
    words = F.filter(F.split("text", " "), lambda x: x != "")
    unique = F.array_sort(F.array_distinct(words))
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", words.alias("ws"), unique.alias("u"))
    left = F.filter("u", lambda x: ~F.startswith(x, F.lit("th")))
    return rows.select("doc_id", F.size("u").alias("distinct_words"), F.get("u", 0).alias("first"), F.array_contains("ws", "and").alias("has_and"), F.size(left).alias("without_prefix"))


@query("""
WITH r AS (SELECT o_orderkey AS review_id, o_custkey AS source_id, o_orderdate AS observed_at, CASE WHEN o_totalprice > 150000 THEN o_orderkey + 1 END AS superseded_by FROM orders)
SELECT review_id, source_id FROM r WHERE observed_at <= TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM r l WHERE l.review_id = r.superseded_by AND l.observed_at <= TIMESTAMP '1996-01-01')""")
def effective_reviews(spark, sf_dir):
    """Reviews that no correction known by then supersedes."""
    from annalist.operators import governance

    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS review_id", "o_custkey AS source_id", "o_orderdate AS observed_at", "CASE WHEN o_totalprice > 150000 THEN o_orderkey + 1 END AS superseded_by")
    return governance.effective_reviews(rows, at("1996-01-01")).select("review_id", "source_id")
