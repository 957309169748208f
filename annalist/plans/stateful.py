"""Folds over event logs. Those that SQL can follow step by step have a recursive query; tests hold the others against plain loops."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.operators import stateful
from annalist.operators.shared import scratch
from annalist.plans.base import ORACLE_SQL, at, query, shape, table
from annalist.streaming import folds

HOUR = 3600 * 1_000_000


def _events(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us")
    return table(spark, sf_dir, "events").select("user_id", "event_id", us, "event_type", "value")


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
r AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, CAST([] AS BIGINT[]) AS taken, false AS accepted FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, n, event_id, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, len(live) < 3
  FROM (SELECT e.user_id, e.n, e.event_id, e.t, list_filter(r.taken, lambda x: x > e.t - {24 * HOUR}) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, event_id, accepted, (3 - len(taken))::INTEGER AS remaining FROM r WHERE n > 0""")
def sliding_budget(spark, sf_dir):
    """Requests that a sliding budget lets pass; refused ones do not count."""
    step = stateful.budget_step(3, 24 * HOUR)
    return stateful.folded(_events(spark, sf_dir), "user_id", ["at_us", "event_id"], step, stateful.budget_start, "user_id long, event_id long, accepted boolean, remaining int")


BREAKER = "user_id long, event_id long, model string, outcome string, state string, generation int, failures int, all_state string"


@query()
def circuit_breaker(spark, sf_dir):
    """Gates that failures open, probes close again and operators resume."""
    rows = _events(spark, sf_dir).withColumn("model", F.concat(F.lit("m"), F.pmod("event_id", F.lit(2))))
    kind = F.when(F.col("event_type").isin("view", "click", "purchase"), "acquire").when((F.col("event_type") == "signup") & (F.col("value") > 80), "resume").otherwise("record")
    model = F.when((kind == "resume") & (F.col("value") > 120), "*").otherwise(F.col("model"))
    category = F.when(F.col("event_type") == "signup", F.lit(None)).when(F.col("value") < 20, "rate_limit").when(F.col("value") < 60, "transport").when(F.col("value") < 90, "rejected").when(F.col("value") < 200, "invalid_response").otherwise("quota")
    rows = rows.withColumns({"kind": kind, "model": model, "category": category, "retry_after_us": F.when(F.col("value") < 5, F.lit(30 * HOUR))})
    before = Window.partitionBy("user_id", "model").orderBy("at_us", "event_id")
    rows = rows.withColumn("permit", F.last(F.when(F.col("kind") == "acquire", F.col("event_id")), ignorenulls=True).over(before))
    step = stateful.breaker_step(2, 12 * HOUR, 96 * HOUR, 6 * HOUR)
    return stateful.folded(rows, "user_id", ["at_us", "event_id"], step, stateful.breaker_start, BREAKER)


QUEUE = "user_id long, event_id long, state string, attempts int, most int, available_us long, archived boolean, applied boolean"
_KIND = """
CASE WHEN event_type = 'view' OR (event_type = 'click' AND value <= 60) THEN 'claim' WHEN event_type = 'purchase' THEN CASE WHEN value > 150 THEN 'complete' ELSE 'heartbeat' END
     WHEN event_type = 'error' THEN CASE WHEN value > 100 THEN 'fail_permanent' ELSE 'fail_temporary' END
     WHEN event_type = 'click' THEN CASE WHEN value > 300 THEN 'archive' ELSE 'relaunch' END ELSE 'defer' END"""
_LIVE = "NOT r.archived"
#: Workers name the attempt they run; some are stale.
_ATTEMPT = "1 + event_id % 3"
_OWN = "(r.state = 'running' AND r.lease > e.t AND e.attempt = r.attempts)"
_CLAIM = "(e.kind = 'claim' AND r.attempts < r.most AND ((r.state IN ('queued', 'retry_wait') AND r.available <= e.t) OR (r.state = 'running' AND r.lease <= e.t)))"
_RETRY = "(e.kind = 'fail_temporary' AND r.attempts < r.most)"
_WAIT = f"least({2 * HOUR} * (1::BIGINT << least(greatest(r.attempts - r.cycle - r.deferred - 1, 0), 20)), {24 * HOUR})"


@query(f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) AS t, {_KIND} AS kind, {_ATTEMPT} AS attempt, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
r AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 'queued' AS state, 0::BIGINT AS attempts, 3::BIGINT AS most, 0::BIGINT AS cycle, 0::BIGINT AS deferred, 0::BIGINT AS lease,
         0::BIGINT AS available, false AS archived, false AS applied
  FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, n, event_id,
    CASE act WHEN 'claim' THEN 'running' WHEN 'complete' THEN 'succeeded' WHEN 'retry' THEN 'retry_wait' WHEN 'fail' THEN 'failed' WHEN 'defer' THEN 'retry_wait' WHEN 'relaunch' THEN 'queued' ELSE state END,
    CASE act WHEN 'claim' THEN attempts + 1 ELSE attempts END,
    CASE act WHEN 'defer' THEN most + 1 WHEN 'relaunch' THEN attempts + 3 ELSE most END,
    CASE act WHEN 'relaunch' THEN attempts ELSE cycle END,
    CASE act WHEN 'defer' THEN deferred + 1 WHEN 'relaunch' THEN 0 ELSE deferred END,
    CASE WHEN act IN ('claim', 'heartbeat') THEN t + {48 * HOUR} ELSE lease END,
    CASE act WHEN 'retry' THEN t + wait WHEN 'fail' THEN t WHEN 'defer' THEN t + {6 * HOUR} WHEN 'relaunch' THEN t ELSE available END,
    archived OR act = 'archive', act <> 'none' AND NOT (act = 'heartbeat' AND lease = t + {48 * HOUR})
  FROM (
    SELECT r.* EXCLUDE (n, event_id), e.n, e.event_id, e.t, {_WAIT} AS wait,
      CASE WHEN NOT ({_LIVE}) THEN 'none' WHEN {_CLAIM} THEN 'claim' WHEN e.kind = 'heartbeat' AND {_OWN} THEN 'heartbeat' WHEN e.kind = 'complete' AND {_OWN} THEN 'complete'
           WHEN {_RETRY} AND {_OWN} THEN 'retry' WHEN e.kind IN ('fail_temporary', 'fail_permanent') AND {_OWN} THEN 'fail' WHEN e.kind = 'defer' AND {_OWN} THEN 'defer'
           WHEN e.kind = 'relaunch' AND r.state = 'failed' AND e.attempt = r.attempts THEN 'relaunch' WHEN e.kind = 'archive' AND r.state IN ('queued', 'retry_wait', 'failed') THEN 'archive' ELSE 'none' END AS act
    FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, event_id, state, attempts::INTEGER AS attempts, most::INTEGER AS most, available AS available_us, archived, applied FROM r WHERE n > 0""")
def queue_fold(spark, sf_dir):
    """Transitions of jobs from their log, by the attempt that runs."""
    rows = _events(spark, sf_dir).withColumns({"kind": F.expr(_KIND), "until_us": F.col("at_us") + 6 * HOUR, "attempt": F.expr(_ATTEMPT)})
    return stateful.folded(rows, "user_id", ["at_us", "event_id"], stateful.queue_step(48 * HOUR, 2 * HOUR), stateful.queue_start, QUEUE)


#: Events in a file of the log, and jobs that share a state of the stream.
EVENTS_A_FILE, KEYS_A_BUCKET = 500_000, 128


@query(ORACLE_SQL["queue_fold"])
def queue_stream(spark, sf_dir):
    """The same transitions from a stream whose micro-batches hold events of several days in any order: timers of event time give the rows of the batch form."""
    rows = _events(spark, sf_dir).withColumns({"kind": F.expr(_KIND), "until_us": F.col("at_us") + 6 * HOUR, "attempt": F.expr(_ATTEMPT), "at": F.timestamp_micros("at_us")})
    days = F.floor((F.col("at_us") - rows.agg(F.min("at_us")).first()[0]) / (24 * HOUR))
    rows = rows.withColumn("batch", F.floor(days / 6) + F.pmod("event_id", F.lit(2)))
    path, sizes = scratch(spark, "event-log"), rows.groupBy("batch").agg(F.count("*").alias("n"), F.max("at_us").alias("last")).orderBy("batch").collect()  # a row for six days
    files = [-(-r["n"] // EVENTS_A_FILE) for r in sizes]
    for r, n in zip(sizes, files, strict=True):  # the newest of a file come last
        rows.where(F.col("batch") == r["batch"]).drop("batch").repartition(n).sortWithinPartitions(F.desc("event_id")).write.mode("append").parquet(path)
    end = max(r["last"] for r in sizes) + 30 * 24 * HOUR
    ahead = rows.limit(1).withColumns({"user_id": F.lit(-1).cast("long"), "at_us": F.lit(end), "at": F.timestamp_micros(F.lit(end))})
    ahead.drop("batch").coalesce(1).write.mode("append").parquet(path)  # time goes on, so that all timers end
    stream = spark.readStream.schema(rows.drop("batch").schema).option("maxFilesPerTrigger", max(files)).parquet(path)
    step = stateful.queue_step(48 * HOUR, 2 * HOUR)
    buckets = -(-rows.agg(F.approx_count_distinct("user_id")).first()[0] // KEYS_A_BUCKET)
    found = folds.timed(stream, "user_id", "at", ["at_us", "event_id"], step, stateful.queue_start, QUEUE, "20 days", buckets=buckets)
    out = scratch(spark, "queue-stream")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "queue-stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out).where("user_id >= 0")


#: Logs of gates and rejections, and events of jobs, of seven scopes with two models each.
_GATES = f"""
SELECT user_id % 7 AS scope, CASE WHEN value > 150 THEN '*' ELSE 'm' || event_id % 2 END AS model, t AS at_us, CASE event_id % 3 WHEN 0 THEN 'held' WHEN 1 THEN 'open' ELSE 'closed' END AS state,
  t + {3 * HOUR} AS available_us, CASE WHEN event_id % 5 = 0 THEN t + {9 * HOUR} END AS probe_us FROM e WHERE event_type = 'signup'"""
_REJECTIONS = "SELECT user_id % 7 AS scope, 'm' || user_id % 2 AS model, 'i' || user_id % 50 AS input, t AS at_us, CASE WHEN value > 40 THEN 'clear' ELSE 'reject' END AS kind FROM e WHERE event_type = 'error' AND event_id % 11 = 0"
_JOBS = """
SELECT user_id % 7 AS scope, 'm' || user_id % 2 AS model, 'i' || user_id % 50 AS input, t AS at_us, user_id, event_id, 1 + event_id % 3 AS attempt,
  CASE WHEN event_type = 'view' THEN 'claim' WHEN event_type = 'click' THEN 'sweep' WHEN event_type = 'purchase' THEN CASE WHEN value > 100 THEN 'held' ELSE 'complete' END ELSE 'fail_temporary' END AS kind
FROM e WHERE event_type <> 'signup' AND NOT (event_type = 'error' AND event_id % 11 = 0)"""
_WAITED = f"CASE {{g}}.state WHEN 'held' THEN j.at_us + {60 * 1_000_000} WHEN 'open' THEN greatest({{g}}.available_us, coalesce({{g}}.probe_us, {{g}}.available_us)) END"


@query(f"""
WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS t FROM events), g AS ({_GATES}), x AS ({_REJECTIONS}), j AS ({_JOBS}),
s AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY scope, model, at_us ORDER BY state, available_us, probe_us) = 1),
w AS (
  SELECT j.*, greatest({_WAITED.format(g="a")}, {_WAITED.format(g="o")}) AS wait, coalesce(b.kind = 'reject', false) AS rejected, row_number() OVER (PARTITION BY user_id ORDER BY j.at_us, event_id) AS n
  FROM j ASOF LEFT JOIN (SELECT * FROM s WHERE model = '*') a ON j.scope = a.scope AND j.at_us >= a.at_us ASOF LEFT JOIN (SELECT * FROM s WHERE model <> '*') o ON j.scope = o.scope AND j.model = o.model AND j.at_us >= o.at_us
    ASOF LEFT JOIN x b ON j.scope = b.scope AND j.model = b.model AND j.input = b.input AND j.at_us >= b.at_us),
r AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 'queued' AS state, 0::BIGINT AS attempts, 3::BIGINT AS most, 0::BIGINT AS deferred, 0::BIGINT AS lease, 0::BIGINT AS available, NULL::VARCHAR AS detail
  FROM (SELECT DISTINCT user_id FROM w)
  UNION ALL
  SELECT user_id, n, event_id,
    CASE act WHEN 'reject' THEN 'failed' WHEN 'claim' THEN 'running' WHEN 'complete' THEN 'succeeded' WHEN 'defer' THEN 'retry_wait' WHEN 'retry' THEN 'retry_wait' WHEN 'fail' THEN 'failed' ELSE state END,
    CASE act WHEN 'claim' THEN attempts + 1 ELSE attempts END, CASE act WHEN 'defer' THEN most + 1 ELSE most END, CASE act WHEN 'defer' THEN deferred + 1 ELSE deferred END,
    CASE act WHEN 'claim' THEN t + {48 * HOUR} ELSE lease END,
    CASE act WHEN 'hold' THEN greatest(available, wait) WHEN 'defer' THEN wait WHEN 'retry' THEN t + least({2 * HOUR} * (1::BIGINT << least(greatest(attempts - deferred - 1, 0), 20)), {24 * HOUR}) WHEN 'fail' THEN t WHEN 'reject' THEN t ELSE available END,
    CASE WHEN act = 'hold' AND wait > available THEN 'held' WHEN act = 'defer' THEN 'given_back' WHEN act = 'reject' THEN 'rejected' END
  FROM (
    SELECT r.* EXCLUDE (n, event_id, detail), w.n, w.event_id, w.at_us AS t, w.wait,
      CASE WHEN w.wait > w.at_us AND w.kind IN ('claim', 'sweep') AND r.state IN ('queued', 'retry_wait') THEN 'hold'
           WHEN w.kind = 'held' AND w.wait > w.at_us AND r.state = 'running' AND r.lease > w.at_us AND w.attempt = r.attempts THEN 'defer'
           WHEN w.kind = 'claim' AND w.rejected AND r.state IN ('queued', 'retry_wait') AND r.available <= w.at_us THEN 'reject'
           WHEN w.kind = 'claim' AND r.attempts < r.most AND (r.state IN ('queued', 'retry_wait') AND r.available <= w.at_us OR r.state = 'running' AND r.lease <= w.at_us) THEN 'claim'
           WHEN w.kind = 'complete' AND r.state = 'running' AND r.lease > w.at_us AND w.attempt = r.attempts THEN 'complete'
           WHEN w.kind = 'fail_temporary' AND r.state = 'running' AND r.lease > w.at_us AND w.attempt = r.attempts THEN CASE WHEN r.attempts < r.most THEN 'retry' ELSE 'fail' END ELSE 'none' END AS act
    FROM r JOIN w ON w.user_id = r.user_id AND w.n = r.n + 1))
SELECT user_id, event_id, state, attempts::INTEGER AS attempts, most::INTEGER AS most, available AS available_us, detail FROM r WHERE n > 0""")
def gated_jobs(spark, sf_dir):
    """Jobs at the gates of their provider: put off while a gate is held or open, attempts given back, rejected input failed until the rejection is cleared."""
    table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).createOrReplaceTempView("e_gated")
    gates, rejections, jobs = (spark.sql(q.replace("FROM e WHERE", "FROM e_gated WHERE")) for q in (_GATES, _REJECTIONS, _JOBS))
    order = Window.partitionBy("scope", "model", "at_us").orderBy("state", F.col("available_us"), F.col("probe_us").asc_nulls_last())
    gates = gates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")  # one change of a gate at a time
    told = stateful.at_gates(jobs, gates, rejections)
    step = stateful.gated_step(stateful.queue_step(48 * HOUR, 2 * HOUR))
    schema = "user_id long, event_id long, state string, attempts int, most int, available_us long, detail string"
    return stateful.folded(told, "user_id", ["at_us", "event_id"], step, stateful.queue_start, schema)


INCIDENT = "user_id long, event_id long, incident int, message string"


@query()
def incident_fold(spark, sf_dir):
    """Incidents opened, reminded of and recovered."""
    kind = F.when(F.col("event_type") == "click", "sent").otherwise("observe")
    category = F.element_at(F.array(*map(F.lit, ("source_delay", "processing_failed", "processing_backlog"))), (F.pmod("user_id", F.lit(3)) + 1).cast("int"))
    rows = _events(spark, sf_dir).withColumns({
        "kind": kind, "category": category, "active": F.col("event_type").isin("error", "view", "signup"),
        "recovery_us": F.when(F.col("value") < 40, F.col("at_us")), "activity_us": F.when(F.col("value") > 20, F.col("at_us") - 2 * HOUR),
    })
    return stateful.folded(rows, "user_id", ["at_us", "event_id"], stateful.incident_step(12 * HOUR), stateful.incident_start, INCIDENT)


@query("""
SELECT job_id, queue, attempt_count + 1 AS attempt_count, 'w1' AS worker, TIMESTAMP '2024-01-16 00:05:00' AS lease_expires_at FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY available_at, job_id) AS n FROM jobs
  WHERE ((state = 'pending' AND available_at <= TIMESTAMP '2024-01-16') OR (state = 'running' AND lease_expires_at <= TIMESTAMP '2024-01-16')) AND attempt_count < max_attempts) WHERE n <= 5""", "jobs")
def queue_claim(spark, sf_dir):
    """The next due jobs of each queue, leased."""
    return stateful.claimed(shape(spark, sf_dir, "jobs"), at("2024-01-16"), 5, "w1", 300)


@query("SELECT incident_id, id FROM (SELECT user_id AS incident_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'click') WHERE n = 1")
def first_unsent(spark, sf_dir):
    """The message each incident sends next."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS incident_id", "event_id AS id", "event_type = 'click' AS sent")
    return stateful.first_unsent(rows).select("incident_id", "id")
