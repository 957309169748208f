"""Aggregates, ledgers and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import money, temporal
from annalist.operators import ledger, reports
from annalist.plans.base import at, query, shape, table


@query("""
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT event_type) AS kinds,
  round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS spent, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY user_id""")
def filter_aggregates(spark, sf_dir):
    """Conditional aggregates."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(kind == "error").alias("errors"), F.countDistinct(kind).alias("kinds"),
        F.round(F.sum(F.when(kind == "purchase", F.col("value"))), 4).alias("spent"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
    )


@query("SELECT user_id, bool_or(event_type = 'error') AS failed_once, bool_and(value > 0) AS all_positive FROM events GROUP BY user_id")
def bool_flags(spark, sf_dir):
    """Flags per group."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("failed_once"), F.bool_and(F.col("value") > 0).alias("all_positive"))


BREAKDOWN = """count(DISTINCT run_id) AS runs, count(*) AS attempts, count(*) FILTER (WHERE number > 1) AS retries, count(*) FILTER (WHERE input_tokens IS NULL) AS usage_unknown,
  count(*) FILTER (WHERE cost IS NULL) AS cost_unknown, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cost)::BIGINT AS cost,
  (sum(cost) FILTER (WHERE number > 1))::BIGINT AS retry_cost"""


@query(f"SELECT workload, stage, currency, {BREAKDOWN} FROM attempts GROUP BY workload, stage, currency", "attempts")
def usage_breakdown(spark, sf_dir):
    """Usage and cost per workload, stage and currency, with retries."""
    return ledger.usage_breakdown(shape(spark, sf_dir, "attempts"), ["workload", "stage", "currency"])


@query("SELECT count(*) AS attempts, sum(input_tokens)::BIGINT AS input_tokens, sum(cost)::BIGINT AS cost, bool_and(cost IS NOT NULL) AS cost_complete FROM attempts WHERE stage = 'O'", "attempts")
def usage_totals_cost_complete(spark, sf_dir):
    """Totals of a scope, and whether every cost is known."""
    return ledger.usage_totals(shape(spark, sf_dir, "attempts").where("stage = 'O'"))


@query("SELECT user_id, 'k' AS metric, sum((props ->> '$.k')::BIGINT)::BIGINT AS amount FROM events WHERE props ->> '$.k' IS NOT NULL GROUP BY user_id")
def map_rollup(spark, sf_dir):
    """Sums per metric of a map."""
    events = table(spark, sf_dir, "events").withColumn("units", F.from_json("props", "map<string,bigint>"))
    return ledger.map_rollup(events, ["user_id"], "units")


@query("""
SELECT o_custkey, '[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']' AS history FROM orders GROUP BY o_custkey""")
def ordered_json_history(spark, sf_dir):
    """Events of each key in order, as JSON."""
    return reports.ordered_history(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus"])


@query("""
WITH l AS (SELECT md5(c_name || '|' || n_name || '|' || r_name) AS line FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT left(line, 2) AS part, md5(string_agg(line, ';' ORDER BY line)) AS hash, count(*) AS n FROM l GROUP BY 1)
SELECT md5(string_agg(hash, ';' ORDER BY part)) AS fingerprint, sum(n)::BIGINT AS rows FROM g""")
def scope_fingerprint(spark, sf_dir):
    """One hash of a scope."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return reports.scope_fingerprint(rows, ["c_name", "n_name", "r_name"])


@query("SELECT run_id, count(*) AS attempts, sum(duration_ms)::BIGINT AS duration_ms, count(*) FILTER (WHERE cost IS NULL) AS unknown, string_agg(DISTINCT currency, ',' ORDER BY currency) AS currencies FROM attempts GROUP BY run_id", "attempts")
def evaluation_runs(spark, sf_dir):
    """Measurement of each run."""
    return ledger.evaluation_runs(shape(spark, sf_dir, "attempts"))


@query("SELECT o_orderkey, (SELECT max(o_orderkey) FROM orders) + 1 AS next_revision FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def scalar_subquery(spark, sf_dir):
    """Scalars over the whole table beside rows."""
    orders = table(spark, sf_dir, "orders")
    tops = orders.agg(F.max("o_totalprice").alias("_top"), (F.max("o_orderkey") + 1).alias("next_revision"))
    return orders.join(F.broadcast(tops), F.col("o_totalprice") == F.col("_top")).select("o_orderkey", "next_revision")  # one row


@query("""
SELECT price_version_id, min(at) AS first_use, max(at) AS last_use, count(*) AS uses, min(at) >= TIMESTAMP '1995-02-01' AND max(at) < TIMESTAMP '1999-06-01' AND price_version_id <> 3 AS valid FROM attempts GROUP BY 1""", "attempts")
def price_assumptions(spark, sf_dir):
    """Whether prices held while they were used."""
    uses = shape(spark, sf_dir, "attempts").select("price_version_id", "at")
    prices = uses.select("price_version_id").distinct().where("price_version_id <> 3").select(
        "price_version_id", at("1995-02-01").alias("effective_from"), at("1999-06-01").alias("effective_to"), at("1990-01-01").alias("observed_at")
    )
    return ledger.price_assumptions(uses, prices).select("price_version_id", "first_use", "last_use", "uses", "valid")


@query("""
SELECT category, workload, component, revision FROM (SELECT stage AS category, workload, currency AS component, id AS revision,
  row_number() OVER (PARTITION BY stage, workload, currency ORDER BY id DESC) AS n FROM attempts) WHERE n = 1""", "attempts")
def latest_inputs(spark, sf_dir):
    """The latest revision of each input."""
    inputs = shape(spark, sf_dir, "attempts").selectExpr("stage AS category", "workload", "currency AS component", "id AS revision")
    return ledger.latest_inputs(inputs)


@query("""
WITH p AS (SELECT stage AS category, workload, count(*) FILTER (WHERE input_tokens IS NULL) AS uu, count(*) FILTER (WHERE cost IS NULL) AS cc FROM attempts GROUP BY 1, 2)
SELECT 'usage_unknown:' || category || ':' || workload AS code FROM p WHERE uu > 0 UNION SELECT 'cost_unknown:' || category || ':' || workload FROM p WHERE cc > 0
UNION SELECT 'currency_mixed' WHERE (SELECT count(DISTINCT currency) FROM attempts) > 1
UNION SELECT 'metric_missing:' || c || ':' || w FROM (VALUES ('O', 'N'), ('F', 'X'), ('storage', 'R')) t(c, w) WHERE NOT EXISTS (SELECT 1 FROM p WHERE category = c AND workload = w)""", "attempts")
def completeness_checklist(spark, sf_dir):
    """Codes of what a report lacks."""
    rows = shape(spark, sf_dir, "attempts")
    present = ledger.usage_breakdown(rows.withColumnRenamed("stage", "category"), ["category", "workload"])
    required = spark.createDataFrame([("O", "N"), ("F", "X"), ("storage", "R")], "category string, workload string")
    return ledger.completeness(present, required, rows.select("currency").distinct())


@query("""
SELECT l_orderkey, l_linenumber, ((l_quantity::HUGEINT * round(l_extendedprice * 100)::BIGINT + 999) // 1000)::BIGINT AS cost FROM lineitem""")
def ceil_cost(spark, sf_dir):
    """Exact price of a quantity, rounded up."""
    price, unit = F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit(1000).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", money.ceil_cost(F.col("l_quantity").cast("long"), price, unit).alias("cost"))


@query("""
SELECT workload, sum(cost)::BIGINT AS spent, ((sum(cost)::HUGEINT * 2592000 + 863999) // 864000)::BIGINT AS monthly FROM attempts GROUP BY workload""", "attempts")
def monthly_projection(spark, sf_dir):
    """What a month costs at the pace of a trial of ten days."""
    spent = shape(spark, sf_dir, "attempts").groupBy("workload").agg(money.total(F.col("cost")).alias("spent"))
    return spent.withColumn("monthly", ledger.monthly_projection(F.col("spent"), F.lit(864000).cast("long")))


@query("""
SELECT run_id, CASE WHEN count(input_tokens) = count(*) THEN 'reported' WHEN count(input_tokens) = 0 THEN 'unavailable' ELSE 'partial' END AS usage_status,
  CASE WHEN count(input_tokens) = count(*) THEN sum(input_tokens)::BIGINT END AS input_tokens FROM attempts GROUP BY run_id""", "attempts")
def call_usage(spark, sf_dir):
    """Whether the usage of a run is reported in full."""
    return ledger.usage_state(shape(spark, sf_dir, "attempts"), ["run_id"])


@query("""
WITH scope AS (SELECT * FROM attempts WHERE at >= TIMESTAMP '1996-01-01' AND at < TIMESTAMP '1998-01-01'),
firsts AS (SELECT run_id, min(number) AS n FROM scope GROUP BY run_id)
SELECT 'attempts' AS section, count(*)::BIGINT AS n, coalesce(sum(input_tokens), 0)::BIGINT AS tokens FROM scope
UNION ALL SELECT 'retries', count(*), coalesce(sum(input_tokens), 0)::BIGINT FROM scope WHERE number > 1
UNION ALL SELECT 'invalid', count(*), coalesce(sum(input_tokens), 0)::BIGINT FROM scope WHERE outcome = 'failed'
UNION ALL SELECT 'deferred', count(*), coalesce(sum(input_tokens), 0)::BIGINT FROM scope WHERE outcome = 'deferred'
UNION ALL SELECT 'reused', count(*), coalesce(sum(input_tokens), 0)::BIGINT FROM scope JOIN firsts USING (run_id) WHERE n > 1
UNION ALL SELECT 'unknown', count(*), 0 FROM scope WHERE input_tokens IS NULL""", "attempts")
def efficiency_report(spark, sf_dir):
    """A report in sections, one pass over the scope for all."""
    rows = shape(spark, sf_dir, "attempts").where((F.col("at") >= at("1996-01-01")) & (F.col("at") < at("1998-01-01")))
    firsts = rows.groupBy(F.col("run_id").alias("_run")).agg(F.min("number").alias("_first"))
    rows = rows.join(firsts, F.col("run_id") == F.col("_run"))
    sections = {
        "attempts": F.lit(True), "retries": F.col("number") > 1, "invalid": F.col("outcome") == "failed", "deferred": F.col("outcome") == "deferred",
        "reused": F.col("_first") > 1, "unknown": F.col("input_tokens").isNull(),
    }
    sums = rows.agg(*[x for s, c in sections.items() for x in (F.count_if(c).alias(f"n_{s}"), F.coalesce(F.sum(F.when(c, F.col("input_tokens"))), F.lit(0)).alias(f"t_{s}"))])
    listed = F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"n_{s}").alias("n"), F.col(f"t_{s}").alias("tokens")) for s in sections])
    return sums.select(F.explode(listed).alias("r")).select("r.*")


@query("""
WITH o AS (SELECT quality, CASE WHEN quality = 1 AND toxic = 0 THEN 'useful' WHEN quality = 1 THEN 'unsupported' WHEN toxic = 0 THEN 'omitted' ELSE 'indeterminate' END AS outcome,
  CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'other' END AS suite FROM labels JOIN documents USING (doc_id))
SELECT suite, count(*) FILTER (WHERE outcome = 'useful') AS useful, count(*) FILTER (WHERE outcome = 'omitted') AS omitted, count(*) FILTER (WHERE outcome = 'unsupported') AS unsupported,
  count(*) FILTER (WHERE outcome = 'indeterminate') AS indeterminate, count(*) FILTER (WHERE outcome <> 'useful') = 0 AND count(*) FILTER (WHERE outcome = 'useful') > 0 AS passed FROM o GROUP BY suite""")
def regression_report(spark, sf_dir):
    """Useful, omitted and unsupported fields of a suite."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    good, calm = F.col("quality") == 1, F.col("toxic") == 0
    outcome = F.when(good & calm, "useful").when(good, "unsupported").when(calm, "omitted").otherwise("indeterminate")
    suite = F.when(F.col("lang").isin("en", "de"), F.col("lang")).otherwise("other")
    return ledger.regression(rows.select(suite.alias("suite"), outcome.alias("outcome")), ["suite"])


@query("""
WITH r AS (SELECT o_custkey AS document_id, CASE WHEN o_orderstatus = 'F' THEN 'baseline' ELSE 'candidate' END AS variant, o_totalprice < 400000 AS passed FROM orders),
b AS (SELECT document_id FROM r GROUP BY 1 HAVING count(DISTINCT variant) = 2)
SELECT variant, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, variant = 'candidate' AND count(*) FILTER (WHERE NOT passed) = 0 AS accepted
FROM r WHERE document_id IN (SELECT document_id FROM b) GROUP BY variant""")
def variant_comparison(spark, sf_dir):
    """A candidate against a baseline over the documents of both."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey AS document_id", "CASE WHEN o_orderstatus = 'F' THEN 'baseline' ELSE 'candidate' END AS variant", "o_totalprice < 400000 AS passed")
    return ledger.variants(rows)


# ---- jobs and schedules

NOW = "TIMESTAMP '2024-01-16'"


@query(f"""
SELECT queue, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'running') AS running, count(*) FILTER (WHERE state = 'succeeded') AS succeeded,
  count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'pending' AND available_at <= {NOW}) AS due,
  count(*) FILTER (WHERE state = 'running' AND lease_expires_at <= {NOW}) AS expired_leases, min(created_at) FILTER (WHERE state = 'pending') AS oldest_pending, max(completed_at) AS last_finished
FROM jobs GROUP BY queue""", "jobs")
def job_groups(spark, sf_dir):
    """State of each queue."""
    return reports.job_groups(shape(spark, sf_dir, "jobs"), ["queue"], at("2024-01-16"))


@query("SELECT queue, error_code, count(*) AS n FROM jobs WHERE error_code IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, queue, error_code LIMIT 5", "jobs")
def failure_reasons(spark, sf_dir):
    """The most frequent errors."""
    return reports.failure_reasons(shape(spark, sf_dir, "jobs"), 5)


@query("""
WITH v AS (SELECT source_id, version_id, CASE WHEN bool_or(state = 'running') THEN 'running' WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_or(state = 'pending') THEN 'waiting' ELSE 'done' END AS category
  FROM jobs GROUP BY 1, 2) SELECT source_id, category, count(*) AS versions FROM v GROUP BY 1, 2""", "jobs")
def pending_categories(spark, sf_dir):
    """Versions of each source by what they wait for."""
    return reports.pending_categories(shape(spark, sf_dir, "jobs"))


@query(f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY at DESC, check_id DESC) AS n FROM checks)
SELECT 'check_failed' AS kind, source_id::VARCHAR AS subject, at AS since FROM l WHERE n = 1 AND NOT complete
UNION ALL SELECT 'source_stale', source_id::VARCHAR, max(at) FROM checks GROUP BY source_id HAVING date_sub('second', max(at), TIMESTAMP '2024-01-31') > 43200
UNION ALL SELECT 'job_failed', job_id::VARCHAR, completed_at FROM jobs WHERE state = 'failed'
UNION ALL SELECT 'lease_expired', job_id::VARCHAR, lease_expires_at FROM jobs WHERE state = 'running' AND lease_expires_at <= TIMESTAMP '2024-01-31'""", "checks jobs")
def attention_findings(spark, sf_dir):
    """What needs attention, from four branches (Q35)."""
    return reports.findings(shape(spark, sf_dir, "checks"), shape(spark, sf_dir, "jobs"), at("2024-01-31"), 43200)


@query("""
SELECT kind, count(*) AS n FROM (SELECT 'checks' AS kind FROM checks UNION ALL SELECT 'jobs' FROM jobs WHERE state = 'pending' UNION ALL SELECT 'failures' FROM jobs WHERE state = 'failed') GROUP BY kind""", "checks jobs")
def overview_counts(spark, sf_dir):
    """Counts over named sections."""
    jobs = shape(spark, sf_dir, "jobs")
    parts = {"checks": shape(spark, sf_dir, "checks"), "jobs": jobs.where("state = 'pending'"), "failures": jobs.where("state = 'failed'")}
    return reports.combined(*[df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in parts.items()])


@query("""
WITH f AS (SELECT source_id::VARCHAR AS scope, count(*) FILTER (WHERE NOT complete AND date_sub('second', at, TIMESTAMP '2024-01-20') <= 259200) AS failures, max(at) FILTER (WHERE complete) AS recovered_at
  FROM checks WHERE at <= TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT scope, 'source' AS category, failures > 2 AS active, failures, recovered_at FROM f
UNION ALL SELECT queue, 'queue', count(*) FILTER (WHERE state = 'failed') > 2, count(*) FILTER (WHERE state = 'failed'), max(completed_at) FILTER (WHERE state = 'succeeded') FROM jobs GROUP BY queue""", "checks jobs")
def incident_signals(spark, sf_dir):
    """Signals from which incidents open and close."""
    return reports.incident_signals(shape(spark, sf_dir, "checks"), shape(spark, sf_dir, "jobs"), at("2024-01-20"), 259200, 2)


@query("""
SELECT workload, sha256(string_agg(DISTINCT concat_ws(chr(0), stage, currency), chr(0) ORDER BY concat_ws(chr(0), stage, currency))) AS digest FROM attempts GROUP BY workload""", "attempts")
def process_digest(spark, sf_dir):
    """A hash of the configurations of a process."""
    return reports.process_digest(shape(spark, sf_dir, "attempts"), ["workload"], ["stage", "currency"])


@query("SELECT state, count(*) AS archived FROM jobs WHERE state IN ('succeeded', 'failed') AND completed_at < TIMESTAMP '2024-01-10' GROUP BY state", "jobs")
def archive_by_state(spark, sf_dir):
    """Finished jobs put away, counted by state."""
    return reports.archived_before(shape(spark, sf_dir, "jobs"), at("2024-01-10"), at("2024-01-20"))[1]


@query("""
SELECT user_id, max(ts) FILTER (WHERE event_type <> 'error') AS last_complete, CASE WHEN max(ts) FILTER (WHERE event_type <> 'error') IS NULL THEN 'not_verified'
  WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'failed' WHEN date_sub('second', max(ts) FILTER (WHERE event_type <> 'error'), TIMESTAMP '2024-01-31') >= 43200 THEN 'delayed' ELSE 'ok' END AS state
FROM events WHERE ts <= TIMESTAMP '2024-01-31' GROUP BY user_id""")
def updating_state(spark, sf_dir):
    """Whether each source is up to date."""
    from annalist.operators import coverage

    return coverage.updating(shape(spark, sf_dir, "checks"), 43200, at("2024-01-31")).withColumnRenamed("source_id", "user_id")


@query("""
SELECT user_id, count(DISTINCT ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome')::DATE) AS local_days FROM events GROUP BY user_id""")
def observed_local_days(spark, sf_dir):
    """Days in Rome on which a source was seen."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct(temporal.local_day(F.col("ts"))).alias("local_days"))


@query("""
WITH l AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS last FROM events WHERE ts <= TIMESTAMP '2024-01-20 07:00:00' GROUP BY user_id)
SELECT user_id, CASE WHEN last >= TIMESTAMP '2024-01-20 05:00:00' THEN 'published' WHEN TIMESTAMP '2024-01-20 07:00:00' <= TIMESTAMP '2024-01-20 07:00:00' THEN 'awaiting' ELSE 'missing' END AS state FROM l""")
def due_state(spark, sf_dir):
    """Whether this cycle's publication is there (D14): cycles of 6 hours, tolerance of an hour, at its last moment."""
    now, anchor = at("2024-01-20 07:00:00"), at("2024-01-01")
    events = table(spark, sf_dir, "events").where(F.col("ts") <= now)
    last = events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last"))
    return last.select("user_id", temporal.due_state(anchor, 6 * 3600, 3600, F.col("last"), now).alias("state"))


@query("""
WITH k AS (SELECT user_id, max((ts, event_id)) FILTER (WHERE event_type = 'purchase') AS ok FROM events GROUP BY user_id),
f AS (SELECT e.user_id, count(*) FILTER (WHERE event_type = 'error' AND (ok IS NULL OR (ts, event_id) > ok)) AS failures FROM events e JOIN k ON e.user_id = k.user_id WHERE event_type <> 'signup' GROUP BY e.user_id)
SELECT user_id, failures, CASE WHEN failures = 0 THEN 0 ELSE least(3600, 60 * power(2, failures - 1))::BIGINT END AS delay_seconds FROM f""")
def backoff_schedule(spark, sf_dir):
    """Delay after failures in a row."""
    from annalist.operators import stateful

    outcome = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'deferred' ELSE 'other' END AS outcome"
    attempts = table(spark, sf_dir, "events").selectExpr("user_id", "ts AS at", "event_id AS id", outcome)
    rows = stateful.failures_since_success(attempts, ["user_id"])
    return rows.select("user_id", "failures", temporal.backoff_seconds(60, 3600, F.col("failures")).alias("delay_seconds"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 13 MONTH AS expires_at, o_orderdate + INTERVAL 13 MONTH <= TIMESTAMP '1998-01-31' AS expired FROM orders")
def calendar_retention(spark, sf_dir):
    """Calendar months, clamped to the month's end."""
    expires = temporal.add_months(F.col("o_orderdate"), 13)
    return table(spark, sf_dir, "orders").select("o_orderkey", expires.alias("expires_at"), (expires <= at("1998-01-31")).alias("expired"))


@query("""
SELECT event_id, round(date_sub('microsecond', TIMESTAMP '2024-01-01', ts) / 1000)::BIGINT AS elapsed_ms, greatest(0, date_sub('second', ts, TIMESTAMP '2024-01-25') // 86400)::BIGINT AS age_days FROM events
WHERE ts <= TIMESTAMP '2024-01-25'""")
def elapsed_and_age(spark, sf_dir):
    """Rounded milliseconds and whole days."""
    rows = table(spark, sf_dir, "events").where(F.col("ts") <= at("2024-01-25"))
    return rows.select("event_id", temporal.milliseconds(at("2024-01-01"), F.col("ts")).alias("elapsed_ms"), temporal.age_days(F.col("ts"), at("2024-01-25")).alias("age_days"))
