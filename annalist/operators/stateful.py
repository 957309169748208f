"""Folds over event logs: queue, circuit breaker, incidents and rate budgets.

Each fold is a plain function over one key's events in order, so the batch form (`folded`) and the
streaming form (`annalist.streaming.folds`) share it. Keys are spread over tasks; the events of
one key are handled in order by one task, in bounded batches of rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

State = dict
Step = Callable[[State, dict], dict | None]


def folded(events: DataFrame, key: str, order: list[str], step: Step, start: Callable[[], State], schema: str) -> DataFrame:
    """Runs `step` over each key's events in order; it returns a row to emit, or None.

    The partition is sorted by Spark and streamed, so a key of any length needs only its state.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), {}
        for batch in batches:
            rows = []
            batch = batch.astype(object).where(batch.notna(), None)  # nulls as None, whole numbers whole
            for event in batch.to_dict("records"):
                if event[key] != current:
                    current, state = event[key], start()
                out = step(state, event)
                if out is not None:
                    rows.append({key: current, **out})
            yield pd.DataFrame(rows, columns=[*names])

    dealt = events.repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInPandas(run, schema)


# ---- exact sliding budget: only accepted requests count


def budget_start() -> State:
    return {"taken": deque()}


def budget_step(limit: int, window_us: int) -> Step:
    def step(state: State, event: dict) -> dict:
        at, taken = int(event["at_us"]), state["taken"]
        while taken and taken[0] <= at - window_us:
            taken.popleft()
        ok = len(taken) < limit
        if ok:
            taken.append(at)
        return {"event_id": event["event_id"], "accepted": ok, "remaining": limit - len(taken)}

    return step


# ---- provider gates: a global one and one per model, with permits, probes and generations


GATE_CATEGORIES = ("authentication", "quota", "permission", "request", "rate_limit", "availability", "transport", "invalid_response", "rejected")


def _gate() -> dict:
    return {"state": "closed", "reason": "", "failures": 0, "generation": 1, "cooldown": 0, "available": 0, "token": None, "probe_until": None}


def breaker_start() -> State:
    return {"gates": {}, "permits": {}}


#: A permit that is not settled within a day does not count any more.
PERMIT_US = 24 * 3600 * 1_000_000


def breaker_step(threshold: int, first_us: int, most_us: int, probe_us: int, permit_us: int = PERMIT_US) -> Step:
    """Gates of one scope: `*` for all its models, and one per model.

    `acquire` (model) asks for a permit, which remembers the generations of both gates. It is refused where a gate is
    held, or open and either not yet available again or lent to a probe; the first one later is the probe.
    `record` (permit: event_id of its acquire, category, null for success, retry_after_us) settles it within `permit_us`, behind which it is forgotten, so that the state does not grow
    by permits that nobody settles:
    - authentication and quota hold the global gate, unless that has changed since;
    - everything else counts only if the global gate is not held, the model's gate has the permit's generation and the permit is its probe, if any;
    - success closes; transient failures open at the threshold, in a probe or with a retry-after, for a time that doubles up to `most_us`;
    - other failures of a probe hold the model's gate, and do nothing to a closed one.
    `resume` (model) opens a gate for a probe; of `*`, it closes that and opens all others. Each change of state takes a new generation.
    """

    def renewed(gate: dict, **changes) -> str:
        gate.update(token=None, probe_until=None, generation=gate["generation"] + 1, **changes)
        return changes["state"]

    def step(s: State, event: dict) -> dict:
        at, model, kind = int(event["at_us"]), event["model"], event["kind"]
        whole = s["gates"].setdefault("*", _gate())
        gate = s["gates"].setdefault(model, _gate())
        outcome, permits = "ignored", s["permits"]
        while permits and (oldest := next(iter(permits))) is not None and permits[oldest][4] <= at - permit_us:
            del permits[oldest]
        if kind == "acquire" and model != "*":
            lent = gate["probe_until"] is not None and at < gate["probe_until"]
            if whole["state"] == "held" or gate["state"] == "held" or (gate["state"] == "open" and (at < gate["available"] or lent)):
                outcome = "blocked"
            else:
                token = event["event_id"] if gate["state"] == "open" else None
                if token is not None:
                    gate.update(token=token, probe_until=at + probe_us)
                permits[event["event_id"]] = (model, gate["generation"], whole["generation"], token, at)
                outcome = "probe" if token is not None else "admitted"
        elif kind == "record" and permits.get(event["permit"], (None,))[0] == model:
            _, generation, whole_generation, token, _ = permits.pop(event["permit"])
            category, wait = event["category"] or "", int(event["retry_after_us"] or 0)
            if category in ("authentication", "quota"):
                if whole["generation"] == whole_generation and (whole["state"], whole["reason"]) != ("held", category):
                    whole.update(state="held", reason=category, generation=whole["generation"] + 1)
                    outcome = "held_all"
            elif whole["state"] != "held" and gate["generation"] == generation and gate["token"] == token:
                if not category:
                    outcome = renewed(gate, state="closed", reason="", failures=0, cooldown=0)
                elif category in ("rate_limit", "availability", "transport"):
                    gate.update(failures=min(gate["failures"] + 1, 1_000_000), reason=category)
                    outcome = "counted"
                    if gate["failures"] >= threshold or gate["state"] == "open" or wait > 0:
                        cooldown = min(gate["cooldown"] * 2 or first_us, most_us)
                        outcome = renewed(gate, state="open", cooldown=cooldown, available=at + max(cooldown, wait))
                elif gate["state"] == "open":
                    outcome = renewed(gate, state="held", reason=category)
        elif kind == "resume":
            renewed(gate, state="closed" if model == "*" else "open", reason="", failures=0, cooldown=0, available=at)
            for name, other in s["gates"].items() if model == "*" else ():
                if name != "*":
                    renewed(other, state="open", available=at)
            outcome = "resumed"
        return {"event_id": event["event_id"], "model": model, "outcome": outcome, "state": gate["state"], "generation": gate["generation"], "failures": gate["failures"], "all_state": whole["state"]}

    return step


# ---- queue transitions of one job

#: A retry never waits longer than this.
MOST_RETRY_US = 24 * 3600 * 1_000_000


def queue_start(budget: int = 3) -> State:
    return {"state": "queued", "attempts": 0, "most": budget, "budget": budget, "cycle": 0, "deferred": 0, "lease": None, "available": 0, "archived": False}


def queue_step(lease_us: int, base_us: int) -> Step:
    """Transitions of a job from its log; those that do not apply change nothing.

    `claim` takes a waiting job that is available, or one whose lease ran out (that attempt is abandoned), while
    attempts are left. `heartbeat`, `complete`, `fail` (temporary or not) and `defer` (until_us) are the running
    attempt's, by its number, while its lease lasts. A temporary failure with attempts left waits base * 2^k, k being
    the earlier attempts of this cycle that were not deferred, a day at most; any other failure is final. Deferring
    waits until then and gives the attempt back by one more allowed. `relaunch` starts a new cycle with a whole budget
    behind a final failure; `archive` ends jobs that wait or failed.
    """

    def step(s: State, event: dict) -> dict:
        at, kind, state, was = int(event["at_us"]), event["kind"], s["state"], dict(s)
        own = state == "running" and event["attempt"] == s["attempts"] and s["lease"] > at
        if s["archived"]:
            pass
        elif kind == "claim" and s["attempts"] < s["most"] and (s["available"] <= at if state in ("queued", "retry_wait") else state == "running" and s["lease"] <= at):
            s.update(state="running", attempts=s["attempts"] + 1, lease=at + lease_us)
        elif kind == "heartbeat" and own:
            s["lease"] = at + lease_us
        elif kind == "complete" and own:
            s.update(state="succeeded", lease=None)
        elif kind in ("fail_temporary", "fail_permanent") and own:
            if kind == "fail_temporary" and s["attempts"] < s["most"]:
                wait = min(base_us << min(max(s["attempts"] - s["cycle"] - s["deferred"] - 1, 0), 20), MOST_RETRY_US)
                s.update(state="retry_wait", lease=None, available=at + wait)
            else:
                s.update(state="failed", lease=None, available=at)
        elif kind == "defer" and own and event["until_us"] > at:
            s.update(state="retry_wait", lease=None, most=s["most"] + 1, available=int(event["until_us"]), deferred=s["deferred"] + 1)
        elif kind == "relaunch" and state == "failed" and event["attempt"] == s["attempts"]:
            s.update(state="queued", most=s["attempts"] + s["budget"], cycle=s["attempts"], deferred=0, available=at)
        elif kind == "archive" and state in ("queued", "retry_wait", "failed"):
            s["archived"] = True
        return {"event_id": event["event_id"], "state": s["state"], "attempts": s["attempts"], "most": s["most"], "available_us": s["available"], "archived": s["archived"], "applied": s != was}

    return step


# ---- jobs at gates: what a provider's gates and rejections do to those that wait

#: A job that meets a held gate waits so long before it asks again.
HELD_US = 60 * 1_000_000


def at_gates(events: DataFrame, gates: DataFrame, rejections: DataFrame) -> DataFrame:
    """Events of jobs (scope, model, input, at_us, event_id) with `wait_us` and `rejected`, as the logs of gates and rejections say at their time.

    `gates` has scope, model (`*` for all), at_us, state, available_us and probe_us; the last row of each gate holds. A held gate is waited for HELD_US from the event on, an open one until it is
    available and its probe is over; of the scope's gate and the model's, the later counts, and closed ones do not. `rejections` has scope, model, input, at_us and kind (`reject`, or
    `clear`, which takes it back). Logs come first at equal times. The three are put in time order in one shuffle by scope; a scope's rows are sorted and streamed by one task.
    """
    gate = "struct<state:string,available_us:long,probe_us:long>"
    own = [c for c in events.columns if c not in ("scope", "model", "input", "at_us")]
    rows = events.select("scope", "model", "input", "at_us", F.lit(1).alias("_side"), F.lit(None).cast(gate).alias("_gate"), F.lit(None).cast("string").alias("_kind"), F.struct(*own).alias("_own"))
    nothing = F.lit(None).cast(rows.schema["_own"].dataType).alias("_own")
    log = gates.select("scope", "model", F.lit(None).cast("string").alias("input"), "at_us", F.lit(0).alias("_side"), F.struct("state", F.col("available_us").cast("long"), F.col("probe_us").cast("long")).cast(gate).alias("_gate"), F.lit(None).cast("string").alias("_kind"), nothing)
    refused = rejections.select("scope", "model", "input", "at_us", F.lit(0).alias("_side"), F.lit(None).cast(gate).alias("_gate"), F.col("kind").alias("_kind"), nothing)

    def last(value: Column, *keys: str) -> Column:
        return F.last(value, ignorenulls=True).over(Window.partitionBy("scope", *keys).orderBy("at_us", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def until(g: Column) -> Column:
        return F.when(g["state"] == "held", F.col("at_us") + HELD_US).when(g["state"] == "open", F.greatest(g["available_us"], F.coalesce(g["probe_us"], g["available_us"])))

    found = rows.union(log).union(refused).withColumns({"_all": last(F.when(F.col("model") == "*", F.col("_gate"))), "_one": last(F.when(F.col("model") != "*", F.col("_gate")), "model"), "_last": last(F.col("_kind"), "model", "input")})
    told = found.where("_side = 1").withColumns({"wait_us": F.greatest(until(F.col("_all")), until(F.col("_one"))), "rejected": F.coalesce(F.col("_last") == "reject", F.lit(False))})
    return told.select("scope", "model", "input", "at_us", *[F.col(f"_own.{c}").alias(c) for c in own], "wait_us", "rejected")


def gated_step(step: Step) -> Step:
    """The transitions of `queue_step` for events of `at_gates`. While the gates are waited for, `claim` and `sweep` only put off a job that waits, and `held` defers the running
    attempt until then, which gives it back. A claim of rejected input fails the job without an attempt."""

    def gated(s: State, event: dict) -> dict:
        at, kind, wait = int(event["at_us"]), event["kind"], event["wait_us"]
        waits = s["state"] in ("queued", "retry_wait") and not s["archived"]
        detail, before = None, dict(s)
        if wait is not None and wait > at and kind in ("claim", "sweep") and waits:
            s["available"], detail, kind = max(s["available"], int(wait)), "held", "none"
        elif kind == "held":
            kind, detail = ("defer", "given_back") if wait is not None and wait > at else ("none", None)
        elif kind == "claim" and event["rejected"] and waits and s["available"] <= at:
            s.update(state="failed", lease=None, available=at)
            detail, kind = "rejected", "none"
        out = step(s, event | {"kind": kind, "until_us": wait})
        applied = s != before
        return out | {"applied": applied, "detail": detail if applied else None}

    return gated


# ---- incidents


def incident_start() -> State:
    return {"opened": None, "number": 0, "notified": None, "seen": None, "unsent": deque()}


def incident_step(remind_us: int) -> Step:
    """Messages about one category and scope, from `observe` and `sent` events.

    Opened by the first active observation; recovered by an inactive one whose recovery (recovery_us) is not before the
    opening. Reminded of while active, an interval behind the last message sent, a day at least for
    `processing_backlog`; for `processing_failed` only if activity_us is newer than the last sent message;
    never while a message waits. `sent` delivers the oldest message that waits.
    """

    def step(s: State, event: dict) -> dict | None:
        at, out = int(event["at_us"]), None
        if event["kind"] == "sent":
            if s["unsent"]:
                number, made = s["unsent"].popleft()
                if number == s["number"] and s["opened"] is not None:
                    s.update(notified=at, seen=made)
            return None
        if s["opened"] is None:
            if event["active"]:
                s.update(opened=at, number=s["number"] + 1, notified=None, seen=None)
                out = "opened"
        elif not event["active"]:
            if event["recovery_us"] is not None and event["recovery_us"] >= s["opened"]:
                s["opened"] = None
                out = "recovered"
        elif remind_us and s["notified"] is not None:
            wait = max(remind_us, MOST_RETRY_US) if event["category"] == "processing_backlog" else remind_us
            newer = event["category"] != "processing_failed" or (event["activity_us"] is not None and event["activity_us"] > s["seen"])
            if at >= s["notified"] + wait and newer and not any(number == s["number"] for number, _ in s["unsent"]):
                out = "reminder"
        if out is None:
            return None
        s["unsent"].append((s["number"], at))
        return {"event_id": event["event_id"], "incident": s["number"], "message": out}

    return step


# ---- batch forms without a fold


def claimed(jobs: DataFrame, at: Column, per_queue: int, worker: str, lease_seconds: int) -> DataFrame:
    """The next due jobs of each queue, earliest available first, with a lease; jobs whose lease ran out are due again."""
    due = ((F.col("state") == "pending") & (F.col("available_at") <= at)) | ((F.col("state") == "running") & (F.col("lease_expires_at") <= at))
    order = Window.partitionBy("queue").orderBy("available_at", "job_id")
    rows = jobs.where(due & (F.col("attempt_count") < F.col("max_attempts"))).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_queue)
    lease = at + F.make_dt_interval(secs=F.lit(lease_seconds))
    return rows.select("job_id", "queue", (F.col("attempt_count") + 1).alias("attempt_count"), F.lit(worker).alias("worker"), lease.alias("lease_expires_at"))


def failures_since_success(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Failures in a row at each key's end, deferred attempts not counted."""
    counted = attempts.where(F.col("outcome") != "deferred")
    last_ok = F.max(F.when(F.col("outcome") == "succeeded", F.struct("at", "id"))).over(Window.partitionBy(*keys))
    behind = last_ok.isNull() | (F.struct("at", "id") > last_ok)
    return counted.withColumn("_f", (F.col("outcome") == "failed") & behind).groupBy(*keys).agg(F.count_if("_f").alias("failures"), F.max("at").alias("last_at"))


def first_unsent(messages: DataFrame) -> DataFrame:
    """The message to deliver next for each incident: the first that is not sent."""
    order = Window.partitionBy("incident_id").orderBy("id")
    return messages.where(~F.col("sent")).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
