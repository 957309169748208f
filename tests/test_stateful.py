"""Folds against plain loops, and their streaming forms."""

import random

import pytest
from pyspark.sql import functions as F

from annalist.operators import stateful
from annalist.streaming import folds

SECOND = 1_000_000


@pytest.fixture(scope="module")
def log():
    """Events of three keys that fit every fold; permits are drawn among the last acquires, so that some are stale."""
    rng = random.Random(4)
    rows, now, asked = [], 0, {}
    kinds = ["claim", "claim", "heartbeat", "complete", "fail_temporary", "fail_temporary", "fail_permanent", "defer", "relaunch", "archive", "resume", *["acquire", "record"] * 8, *["observe"] * 4, *["sent"] * 4]
    for i in range(4500):
        now += rng.choice([0, 1, 5, 20, 90]) * SECOND
        key, kind, model = rng.choice("abc"), rng.choice(kinds), rng.choice(["m", "n"] + ["*"] * (rng.random() < 0.1))
        permit = rng.choice(asked.get((key, model), [-1])[-3:])
        if kind == "acquire":
            asked.setdefault((key, model), []).append(i)
        maybe = lambda x: x if rng.random() < 0.6 else None
        rows.append((
            key, i, now, kind, rng.random() < 0.85, rng.randint(1, 9), now + rng.randint(-50, 200) * SECOND, model, permit,
            rng.choice([None, None, "transport", "rate_limit", "rejected", "request"] + ["quota"] * (rng.random() < 0.15)), maybe(rng.choice([0, 0, 50 * SECOND])),
            {"a": "processing_failed", "b": "processing_backlog", "c": "source_delay"}[key], maybe(now - rng.randint(0, 900) * SECOND), maybe(now - rng.randint(0, 400) * SECOND),
        ))
    return rows


SCHEMA = "k string, event_id long, at_us long, kind string, active boolean, attempt int, until_us long, model string, permit long, category_ string, retry_after_us long, category string, recovery_us long, activity_us long"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def gate_events(step):
    return lambda state, event: step(state, event | {"category": event["category_"]})


def any_attempt(step):
    """Every third event names its attempt itself, which most often is a stale one."""
    return lambda state, event: step(state, event if event["event_id"] % 3 == 0 else event | {"attempt": state["attempts"]})


CASES = {
    "budget": (stateful.budget_step(3, 60 * SECOND), stateful.budget_start, "k string, event_id long, accepted boolean, remaining int"),
    "breaker": (gate_events(stateful.breaker_step(2, 90 * SECOND, 400 * SECOND, 60 * SECOND)), stateful.breaker_start, "k string, event_id long, model string, outcome string, state string, generation int, failures int, all_state string"),
    "queue": (any_attempt(stateful.queue_step(200 * SECOND, 30 * SECOND)), stateful.queue_start, "k string, event_id long, state string, attempts int, most int, available_us long, archived boolean, applied boolean"),
    "incident": (stateful.incident_step(300 * SECOND), stateful.incident_start, "k string, event_id long, incident int, message string"),
}


def looped(log, step, start):
    states, out = {}, []
    for row in log:
        event = dict(zip(NAMES, row, strict=True))
        made = step(states.setdefault(event["k"], start()), event)
        if made is not None:
            out.append((event["k"], *made.values()))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(CASES))
def test_batch_fold_is_the_loop(spark, log, name):
    step, start, schema = CASES[name]
    events = spark.createDataFrame(log, SCHEMA).repartition(5)
    found = stateful.folded(events, "k", ["at_us", "event_id"], step, start, schema)
    assert sorted(map(tuple, found.collect())) == looped(log, step, start)


def test_gates_by_another_hand(log):
    """The last write to each field decides: gates as tuples of a history, permits looked up in it."""
    step, start, _ = CASES["breaker"]
    want = []
    for key in "abc":
        gates, permits = {}, {}  # model: [state, reason, failures, generation, cooldown, available, probe, probe end]
        for event in (dict(zip(NAMES, r, strict=True)) for r in log if r[0] == key):
            now, m = event["at_us"], event["model"]
            for name in ("*", m):
                gates.setdefault(name, ["closed", "", 0, 1, 0, 0, None, None])
            top, g, said = gates["*"], gates[m], "ignored"
            if event["kind"] == "acquire" and m != "*":
                waits = g[0] == "open" and (g[5] > now or (g[7] is not None and g[7] > now))
                if "held" in (top[0], g[0]) or waits:
                    said = "blocked"
                elif g[0] == "open":
                    g[6:], said = [event["event_id"], now + 60 * SECOND], "probe"
                    permits[event["event_id"]] = (m, g[3], top[3], event["event_id"])
                else:
                    said, permits[event["event_id"]] = "admitted", (m, g[3], top[3], None)
            elif event["kind"] == "record" and event["permit"] in permits and permits[event["permit"]][0] == m:
                _, own, whole, probe = permits.pop(event["permit"])
                category, wait = event["category_"], event["retry_after_us"] or 0
                if category == "quota":
                    if whole == top[3] and not (top[0] == "held" and top[1] == "quota"):
                        top[0], top[1], top[3], said = "held", "quota", top[3] + 1, "held_all"
                elif top[0] != "held" and own == g[3] and probe == g[6]:
                    if category is None:
                        g[:], said = ["closed", "", 0, g[3] + 1, 0, g[5], None, None], "closed"
                    elif category in ("transport", "rate_limit"):
                        g[2] += 1
                        g[1], said = category, "counted"
                        if g[2] > 1 or g[0] == "open" or wait:
                            cool = min(400 * SECOND, 2 * g[4] if g[4] else 90 * SECOND)
                            g[:], said = ["open", category, g[2], g[3] + 1, cool, now + max(cool, wait), None, None], "open"
                    elif g[0] == "open":
                        g[0], g[1], g[3], g[6:], said = "held", category, g[3] + 1, [None, None], "held"
            elif event["kind"] == "resume":
                said = "resumed"
                for name, other in gates.items() if m == "*" else [(m, g)]:
                    if name == m:
                        other[:] = ["closed" if m == "*" else "open", "", 0, other[3] + 1, 0, now, None, None]
                    else:
                        other[0], other[3], other[5:] = "open", other[3] + 1, [now, None, None]
            want.append((key, event["event_id"], m, said, g[0], g[3], g[2], top[0]))
    assert looped(log, step, start) == sorted(want)
    assert {w[3] for w in want} == {"ignored", "blocked", "probe", "admitted", "held_all", "closed", "counted", "open", "held", "resumed"}


def test_incidents_by_another_hand(log):
    step, start, _ = CASES["incident"]
    want = []
    for key in "abc":
        messages, incidents = [], []  # [incident, made, sent, kind] and [opened, recovered]
        for event in (dict(zip(NAMES, r, strict=True)) for r in log if r[0] == key):
            now, made = event["at_us"], None
            if event["kind"] == "sent":
                for x in messages:
                    if x[2] is None:
                        x[2] = now
                        break
                continue
            current = incidents[-1] if incidents and incidents[-1][1] is None else None
            n = len(incidents)
            if current is None and event["active"]:
                incidents.append([now, None])
                n, made = n + 1, "opened"
            elif current and not event["active"]:
                if event["recovery_us"] is not None and not event["recovery_us"] < current[0]:
                    current[1], made = now, "recovered"
            elif current:
                own = [x for x in messages if x[0] == n]
                sent = [x for x in own if x[2] is not None]
                every = 24 * 3600 * SECOND if event["category"] == "processing_backlog" else 300 * SECOND
                if sent and len(sent) == len(own) and now - sent[-1][2] >= every:
                    activity = event["activity_us"]
                    if event["category"] != "processing_failed" or (activity is not None and activity > max(x[1] for x in sent)):
                        made = "reminder"
            if made:
                messages.append([n, now, None])
                want.append((key, event["event_id"], n, made))
    assert looped(log, step, start) == sorted(want)
    assert {w[3] for w in want} == {"opened", "recovered", "reminder"}


def test_retries_leave_deferred_attempts_out():
    step, s = stateful.queue_step(1000, 10), stateful.queue_start()
    do = lambda at, kind, **more: step(s, {"event_id": 1, "at_us": at, "kind": kind, "attempt": s["attempts"], "until_us": at + 5, **more})
    do(0, "claim")
    assert do(1, "fail_temporary")["available_us"] == 11
    assert not do(5, "claim")["applied"]
    do(20, "claim")
    assert (do(21, "defer")["most"], s["available"]) == (4, 26)
    do(30, "claim")
    assert do(31, "fail_temporary")["available_us"] == 51  # the second failure, not the third
    do(60, "claim")
    assert not do(61, "complete", attempt=3)["applied"]  # a stale worker
    assert do(62, "fail_temporary")["state"] == "failed"
    assert (do(70, "relaunch")["most"], s["state"]) == (7, "queued")
    do(71, "claim")
    assert do(2000, "complete")["applied"] is False and do(2000, "claim")["attempts"] == 6  # the lease ran out


@pytest.mark.parametrize("name", ["budget", "breaker"])
def test_streaming_fold_is_the_batch_fold(spark, log, name, tmp_path):
    step, start, schema = CASES[name]
    for i in range(3):  # three micro-batches
        spark.createDataFrame(log[i * 1500 : (i + 1) * 1500], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = folds.streamed(stream, "k", ["at_us", "event_id"], step, start, schema)
    query = out.writeStream.format("memory").queryName(f"out_{name}").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table(f"out_{name}").collect())) == looped(log, step, start)


def test_windowed_history_drops_what_is_too_late(spark, tmp_path):
    def batch(*times):
        rows = spark.createDataFrame([(t, "x") for t in times], "ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    batch("2026-01-01 00:01:00", "2026-01-01 00:04:00", "2026-01-01 00:06:00")
    batch("2026-01-01 00:40:00", "2026-01-01 00:02:00")
    batch("2026-01-01 01:30:00")
    batch("2026-01-01 00:01:30")
    stream = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = folds.history(stream, "ts", ["kind"], "5 minutes", "10 minutes").writeStream.format("memory").queryName("history").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {str(r.bucket)[11:16]: r.n for r in spark.table("history").collect()}
    assert found["00:00"] == 3 and found["00:05"] == 1  # the event of 00:01:30 came after its bucket was closed


def test_claims_and_failures(spark):
    jobs = spark.createDataFrame(
        [(1, "q", "pending", 10, None, 0, 3), (2, "q", "pending", 5, None, 0, 3), (3, "q", "pending", 99, None, 0, 3), (4, "q", "running", 1, 20, 1, 3), (5, "q", "running", 1, 60, 1, 3), (6, "q", "pending", 1, None, 3, 3)],
        "job_id long, queue string, state string, available int, lease int, attempt_count int, max_attempts int",
    )
    stamp = lambda c: F.timestamp_seconds(c)
    jobs = jobs.withColumn("available_at", stamp(F.col("available"))).withColumn("lease_expires_at", stamp(F.col("lease")))
    got = stateful.claimed(jobs, stamp(F.lit(50)), 2, "w", 30).collect()
    assert sorted((r.job_id, r.attempt_count) for r in got) == [(2, 1), (4, 2)]
    attempts = spark.createDataFrame([("a", 1, 1, "failed"), ("a", 2, 2, "succeeded"), ("a", 3, 3, "failed"), ("a", 4, 4, "deferred"), ("a", 5, 5, "failed"), ("b", 6, 1, "succeeded")], "k string, id long, at int, outcome string")
    assert {r.k: r.failures for r in stateful.failures_since_success(attempts, ["k"]).collect()} == {"a": 2, "b": 0}


def test_permits_that_nobody_settles_are_forgotten():
    step, state = stateful.breaker_step(2, 90 * SECOND, 400 * SECOND, 60 * SECOND, permit_us=100 * SECOND), stateful.breaker_start()
    for i in range(1000):
        step(state, {"event_id": i, "at_us": i * SECOND, "model": "m", "kind": "acquire"})
        assert len(state["permits"]) <= 100
    record = {"model": "m", "kind": "record", "category": "transport", "retry_after_us": None}
    assert step(state, record | {"event_id": 2000, "at_us": 1000 * SECOND, "permit": 900})["outcome"] == "ignored"
    assert step(state, record | {"event_id": 2001, "at_us": 1000 * SECOND, "permit": 950})["outcome"] == "counted"


def test_gates_put_jobs_off_and_give_attempts_back(spark):
    minute = 60 * SECOND
    jobs = [("s", "m", "i", t * minute, 1, n, kind, attempt) for n, (t, kind, attempt) in enumerate([(1, "claim", 0), (2, "held", 1), (3, "sweep", 0), (30, "claim", 0), (31, "held", 9), (32, "held", 2), (50, "claim", 0), (60, "claim", 0), (61, "complete", 3)])]
    gates = [("s", "m", 2 * minute, "open", 20 * minute, None), ("s", "*", 29 * minute, "closed", 0, None), ("s", "m", 30 * minute, "closed", 0, None), ("s", "*", 31 * minute, "held", 0, None), ("s", "*", 49 * minute, "closed", 0, None), ("t", "*", 0, "held", 0, None)]
    rejections = [("s", "m", "i", 50 * minute, "reject"), ("s", "m", "i", 59 * minute, "clear"), ("s", "n", "i", 0, "reject")]
    told = stateful.at_gates(
        spark.createDataFrame(jobs, "scope string, model string, input string, at_us long, job long, event_id long, kind string, attempt int"),
        spark.createDataFrame(gates, "scope string, model string, at_us long, state string, available_us long, probe_us long"),
        spark.createDataFrame(rejections, "scope string, model string, input string, at_us long, kind string"),
    )
    schema = "job long, event_id long, state string, attempts int, most int, available_us long, detail string"
    step = stateful.gated_step(stateful.queue_step(100 * minute, minute))
    found = stateful.folded(told, "job", ["at_us", "event_id"], step, stateful.queue_start, schema)
    rows = [(r.event_id, r.state, r.attempts, r.most, r.available_us // minute, r.detail) for r in found.orderBy("event_id").collect()]
    assert rows == [
        (0, "running", 1, 3, 0, None), (1, "retry_wait", 1, 4, 20, "given_back"), (2, "retry_wait", 1, 4, 20, None), (3, "running", 2, 4, 20, None), (4, "running", 2, 4, 20, None),
        (5, "retry_wait", 2, 5, 33, "given_back"), (6, "failed", 2, 5, 50, "rejected"), (7, "failed", 2, 5, 50, None), (8, "failed", 2, 5, 50, None),
    ]


DAY = 24 * 3600 * SECOND


def _streamed_out(spark, tmp_path, batches, name, late, idle_us=None):
    """The fold of the queue over micro-batches of (k, event_id, at_us, kind, attempt), in the order given."""
    schema = "k string, event_id long, at_us long, kind string, attempt int, until_us long"
    for rows in batches:
        spark.createDataFrame([(*r, r[2] + 50 * SECOND) for r in rows], schema).withColumn("at", F.timestamp_micros("at_us")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{schema}, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    step = stateful.queue_step(200 * SECOND, 30 * SECOND)
    out = folds.timed(stream, "k", "at", ["at_us", "event_id"], step, stateful.queue_start, CASES["queue"][2], late, idle_us)
    out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(200)
    return sorted(tuple(r) for r in spark.table(name).where("k <> 'end'").collect())


def test_timed_fold_does_not_depend_on_micro_batches(spark, log, tmp_path):
    rng = random.Random(6)
    rows = [(r[0], r[1], r[2], r[3], r[5] % 3 + 1) for r in log if r[3] in ("claim", "heartbeat", "complete", "fail_temporary", "fail_permanent", "defer", "relaunch", "archive")]
    span = rows[-1][2] // 6 + 1
    batches = [[] for _ in range(8)]
    for r in rows:
        batches[r[2] // span + rng.randrange(2)].append(r)
    for b in batches:
        rng.shuffle(b)
    batches = [b for b in batches if b] + [[("end", 10**6, rows[-1][2] + 9 * span, "claim", 1)]]
    got = _streamed_out(spark, tmp_path, batches, "timed_queue", f"{2 * span // SECOND + 1} seconds")
    names, states, want = ["k", "event_id", "at_us", "kind", "attempt"], {}, []
    for r in rows:
        event = dict(zip(names, r, strict=True)) | {"until_us": r[2] + 50 * SECOND}
        out = stateful.queue_step(200 * SECOND, 30 * SECOND)(states.setdefault(r[0], stateful.queue_start()), event)
        want.append((r[0], *out.values()))
    assert got == sorted(want)


def test_idle_keys_expire_and_begin_anew(spark, tmp_path):
    batches = [[("a", 1, DAY, "claim", 1), ("b", 2, DAY, "claim", 1)], [("b", 3, 2 * DAY, "claim", 1)], [("c", 4, 9 * DAY, "claim", 1)], [("a", 5, 10 * DAY, "claim", 1), ("b", 6, 10 * DAY, "claim", 1)], [("end", 7, 40 * DAY, "claim", 1)]]
    for name, idle, attempts in (("kept", None, 2), ("expired", 3 * DAY, 1)):
        got = {r[1]: r[3] for r in _streamed_out(spark, tmp_path / name, batches, name, "1 day", idle)}
        assert got == {1: 1, 2: 1, 3: 2, 4: 1, 5: attempts, 6: attempts + 1 if idle is None else 1}
