"""Admission, review, recovery and audit rules over logs of decisions and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text
from annalist.operators import asof


def acceptance_review(reviews: DataFrame, checks: list[str]) -> DataFrame:
    """Reviews with the names of open checks and whether the declared coverage fits its limitations.

    Coverage `declared` has no limitations, `limited` has at least one that is not blank.
    """
    open_ = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in sorted(checks)]))
    blank = F.forall("limitations", lambda x: F.trim(x) == "")
    fits = F.when(F.col("coverage") == "declared", F.size("limitations") == 0).when(F.col("coverage") == "limited", ~blank).otherwise(F.lit(False))
    issues = F.concat(F.transform(open_, lambda c: F.concat(F.lit("pending_"), c)), F.when(fits, F.array().cast("array<string>")).otherwise(F.array(F.lit("coverage"))))
    return reviews.withColumn("issues", issues).withColumn("state", F.when(F.size(issues) == 0, "verified").otherwise("pending"))


def eligible(resources: DataFrame, decorations: DataFrame) -> DataFrame:
    """Resources with `eligible`: only an exact pair of URL and hash that is known as decoration is left out; without a hash nothing is."""
    known = decorations.select(F.col("url").alias("_url"), F.col("object_hash").alias("_hash")).distinct().withColumn("_known", F.lit(True))
    rows = resources.join(known, (F.col("url") == F.col("_url")) & (F.col("object_hash") == F.col("_hash")), "left")
    return rows.withColumn("eligible", F.col("_known").isNull()).drop("_url", "_hash", "_known")


def attachment_allowed(url: Column, suffixes: list[str], prefix: str, extensions: list[str]) -> Column:
    """Whether a URL lies on an allowed host, below a prefix, and has an allowed extension or none."""
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    on_host = F.lit(False)
    for suffix in suffixes:
        on_host = on_host | (host == suffix) | F.endswith(host, F.lit("." + suffix))
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(text.valid_url(url) & on_host & F.startswith(path, F.lit(prefix)) & ((extension == "") | extension.isin(*extensions)), F.lit(False))


def text_layer(pages: DataFrame, key: str, most_pages: int = 500, least_letters: int = 20) -> DataFrame:
    """Whether the text layer of each document can be used: consecutive pages, few enough, with letters and without control characters."""
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    clean = ~F.col("text").rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFD]")
    whole = (F.max("page") - F.min("page") + 1 == F.count("*")) & (F.countDistinct("page") == F.count("*"))
    return pages.groupBy(key).agg((whole & (F.count("*") <= most_pages) & F.bool_and((letters >= least_letters) & clean)).alias("accepted"), F.count("*").alias("pages"))


def unavailable(targets: DataFrame, listings: DataFrame) -> DataFrame:
    """Unavailable targets: excluded by a disposition, withdrawn if the last listing of their source no longer showed them, else blocking."""
    last = listings.groupBy("source_id").agg(F.max("listed_at").alias("_listed"))
    rows = targets.join(last, "source_id", "left")
    state = F.when(F.col("excluded"), "excluded").when(F.col("last_seen_at") < F.col("_listed"), "withdrawn").otherwise("blocking")
    return rows.withColumn("state", state).drop("_listed")


def backfill(versions: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprints that are not stored yet, and counts of what was scanned, written, stored before and not reusable."""
    have = stored.select("version_id").distinct().withColumn("_have", F.lit(True))
    rows = versions.join(have, "version_id", "left")
    reusable, new = F.col("fingerprint").isNotNull(), F.col("_have").isNull()
    counts = rows.agg(F.count("*").alias("scanned"), F.count_if(reusable & new).alias("written"), F.count_if(~reusable & new).alias("not_reusable"), F.count_if(~new).alias("stored"))
    return rows.where(reusable & new).drop("_have"), counts


def archived(pending: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Members of a frozen set that are archived now: the last event of each says so. Recovered ones are out; of equal times and ids a recovery counts last."""
    last = asof.latest(log, [key], ["at", "id", "action"]).where("action = 'archive'").select(key)
    return pending.join(last, key, "left_semi")


def admitted(jobs: DataFrame, switches: DataFrame, per_source: DataFrame, at: Column) -> DataFrame:
    """Jobs with `admitted`: the last global switch and the last one of their source are both on; sources without one are on."""
    on = switches.where(F.col("at") <= at).agg(F.max_by("enabled", F.struct("at", "id")).alias("_global"))
    own = asof.latest(per_source.where(F.col("at") <= at), ["source_id"], ["at", "id"]).select("source_id", F.col("enabled").alias("_own"))
    rows = jobs.join(own, "source_id", "left").crossJoin(F.broadcast(on))  # one row
    return rows.withColumn("admitted", F.coalesce("_global", F.lit(False)) & F.coalesce("_own", F.lit(True))).drop("_global", "_own")


def lines_of_words(words: DataFrame, keys: list[str], tolerance: float = 1.0) -> DataFrame:
    """Positioned words put together to lines: a new one begins where y goes on by more than the tolerance; in a line x decides."""
    order = Window.partitionBy(*keys).orderBy("y", "x", "word")
    jump = F.coalesce(F.col("y") - F.lag("y").over(order) > tolerance, F.lit(True)).cast("int")
    rows = words.withColumn("_new", jump).withColumn("line", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "word"))), lambda w: w["word"]), " ")
    return rows.groupBy(*keys, "line").agg(joined.alias("text"))


def complete_maps(facts: DataFrame, keys: list[str], parts: list[str], expected: int) -> DataFrame:
    """Whether each map has every combination of its parts exactly once."""
    once = facts.groupBy(*keys, *parts).agg(F.count("*").alias("_n"))
    return once.groupBy(*keys).agg(F.count("*").alias("facts"), ((F.count("*") == expected) & (F.max("_n") == 1)).alias("complete"))


def incident_report(incidents: DataFrame, messages: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Counts of open incidents, pending and all messages; and the last messages."""
    counts = incidents.agg(F.count_if(F.col("recovered_at").isNull()).alias("open"), F.count("*").alias("incidents")).crossJoin(
        messages.agg(F.count_if(~F.col("sent")).alias("pending"), F.count("*").alias("messages"))
    )
    return counts, messages.orderBy(F.desc("at"), F.desc("id")).limit(limit)


def backup_due(runs: DataFrame, scope: str, interval_seconds: int, at: Column) -> DataFrame:
    """Per scope: runs, the last that began, when the next is due and whether it is."""
    last = runs.where(F.col("started_at") <= at).groupBy(scope).agg(F.count("*").alias("runs"), F.max("started_at").alias("last_started"))
    due = F.col("last_started") + F.make_dt_interval(secs=F.lit(interval_seconds))
    return last.withColumn("next_due", due).withColumn("due", due <= at)


def content_identity(resources: DataFrame, keys: list[str]) -> DataFrame:
    """Hash of all resources of a version in order, and whether none that is required is missing."""
    line = F.concat_ws("\0", "url", "role", F.coalesce("object_hash", F.lit("")))
    hashed = F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)
    return resources.groupBy(*keys).agg(hashed.alias("identity"), F.bool_and(~F.col("required") | F.col("object_hash").isNotNull()).alias("complete"))


def defect_warnings(measures: DataFrame, suspensions: DataFrame) -> DataFrame:
    """Measures with `reliable`: none of their source's suspensions began at or after their interpretation."""
    last = suspensions.groupBy("source_id").agg(F.max("suspended_at").alias("_last"))
    rows = measures.join(last, "source_id", "left")
    return rows.withColumn("reliable", F.coalesce(F.col("_last") < F.col("recorded_at"), F.lit(True))).drop("_last")


def complete_comparisons(comparisons: DataFrame, key: str, dimensions: list[str]) -> DataFrame:
    """Comparisons with `valid`: each named dimension exactly once, all with evidence, and nothing else."""
    once = F.array_sort(F.collect_list("dimension")) == F.array(*[F.lit(d) for d in sorted(dimensions)])
    return comparisons.groupBy(key).agg((once & F.bool_and(F.coalesce(F.trim("evidence"), F.lit("")) != "")).alias("valid"))


def saved_views(requests: DataFrame, parameters: list[str], seconds: int) -> DataFrame:
    """Requests by the hash of their canonical parameters, with when the first result of each expires and how many share it."""
    canonical = F.concat_ws("&", *[F.concat(F.lit(p + "="), F.coalesce(F.lower(F.trim(F.col(p).cast("string"))), F.lit(""))) for p in sorted(parameters)])
    rows = requests.groupBy(F.sha2(canonical, 256).alias("request_hash")).agg(F.min("at").alias("created_at"), F.count("*").alias("requests"))
    return rows.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(secs=F.lit(seconds)))


def recheck_plan(targets: DataFrame, at: Column, every_seconds: int) -> DataFrame:
    """Why each target is fetched again: never_fetched, changed_listing, retry, stale, or null for not now."""
    age = F.timestamp_diff("SECOND", F.col("fetched_at"), at)
    reason = (
        F.when(F.col("fetched_at").isNull(), "never_fetched").when(F.col("listed_at") > F.col("fetched_at"), "changed_listing")
        .when(F.col("failed") & (age >= every_seconds / 24), "retry").when(age >= every_seconds, "stale")
    )
    return targets.withColumn("reason", reason)


def fallback_route(attempts: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The provider to use next: the fallback once the last `limit` attempts of the primary all failed."""
    recent = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("id"))
    rows = attempts.where("outcome <> 'deferred'").withColumn("_n", F.row_number().over(recent)).where(F.col("_n") <= limit)
    failed = (F.count("*") == limit) & F.bool_and(F.col("outcome") == "failed")
    return rows.groupBy(*keys).agg(F.when(failed, "fallback").otherwise("primary").alias("route"))


def recovery_admission(jobs: DataFrame, keys: list[str], at: Column, most: int) -> DataFrame:
    """Failed jobs that may be relaunched now: of each key the oldest, up to what running ones leave free."""
    running = jobs.where("state = 'running'").groupBy(*keys).agg(F.count("*").alias("_running"))
    order = Window.partitionBy(*keys).orderBy("completed_at", "job_id")
    failed = jobs.where((F.col("state") == "failed") & (F.col("completed_at") <= at)).withColumn("_n", F.row_number().over(order))
    rows = failed.join(running, keys, "left")
    return rows.where(F.col("_n") <= F.lit(most) - F.coalesce("_running", F.lit(0))).drop("_n", "_running")


def single_flight(requests: DataFrame, artifact: str, at: Column) -> DataFrame:
    """Of requests for one artifact the first that is not expired leads, and the rest wait for it or reuse what is finished."""
    live = requests.where((F.col("lease_expires_at") > at) | F.col("finished"))
    order = Window.partitionBy(artifact).orderBy(F.col("finished").desc(), "at", "id")
    place = F.row_number().over(order)
    leads, ready = F.first("id").over(order), F.first("finished").over(order)
    return live.withColumn("_p", place).withColumn("leader", leads).withColumn("role", F.when(ready & (place > 1), "reuses").when(place == 1, "leads").otherwise("waits")).drop("_p")


def checkpoint_reuse(segments: DataFrame, checkpoints: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with the result of the last checkpoint of the same stage, configuration and input, or null."""
    last = asof.latest(checkpoints, keys, ["at", "id"]).select(*keys, F.col("id").alias("checkpoint_id"))
    return segments.join(last, keys, "left")


def effective_reviews(reviews: DataFrame, through: Column) -> DataFrame:
    """Reviews observed by then that no review observed by then supersedes; `superseded_by` names the correction."""
    seen = reviews.where(F.col("observed_at") <= through)
    later = seen.select(F.col("review_id").alias("superseded_by"), F.lit(True).alias("_seen"))
    return seen.join(later, "superseded_by", "left").where(F.col("_seen").isNull()).withColumn("superseded_by", F.lit(None).cast(seen.schema["superseded_by"].dataType)).drop("_seen")


def municipal_summary(versions: DataFrame, sources: DataFrame, known_at: Column) -> DataFrame:
    """Interpretation state of each source by the latest visible versions of its documents: not_processed, supported, or partial if any is incomplete."""
    last = asof.latest(versions.where(F.col("acquired_at") <= known_at), ["document_id"], ["acquired_at", "version_id"])
    counts = last.groupBy("source_id").agg(F.count_if(F.col("state") == "supported").alias("supported"), F.count_if(F.coalesce(F.col("state") != "supported", F.lit(True))).alias("incomplete"))
    rows = sources.join(counts, "source_id", "left").fillna(0, ["supported", "incomplete"])
    return rows.withColumn("state", F.when(F.col("incomplete") > 0, "partial").when(F.col("supported") > 0, "supported").otherwise("not_processed"))


def published_municipalities(publication: DataFrame, regions: DataFrame, municipalities: DataFrame, geography: DataFrame) -> DataFrame:
    """Enabled municipalities of a region that its current version's data set has and supports. `regions` has region_code, revision and the versions' `dataset_id`."""
    offered = municipalities.join(geography.where("supported").select("dataset_id", "istat"), ["dataset_id", "istat"], "left_semi")
    current = regions.where("is_current").select("region_code", "dataset_id")
    return publication.where("enabled").join(offered.join(current, ["region_code", "dataset_id"], "left_semi"), ["region_code", "istat"], "left_semi")


def development_visible(sources: DataFrame, municipalities: DataFrame, configuration: str, profiles: dict[str, str], shared_products: list[str]) -> DataFrame:
    """Sources that may be shown while a region is in development.

    Their configuration (JSON) permits publication, names their origin and nothing unresolved, and fits product and profile; a
    municipal source belongs to a published municipality, a shared product to a region that has one.
    """
    at = lambda path: F.get_json_object(configuration, "$." + path)
    profile = F.element_at(F.create_map(*[F.lit(x) for kv in profiles.items() for x in kv]), F.col("product"))
    fits = (
        F.coalesce(at("policy.publication_permitted") == "true", F.lit(False))
        & (F.coalesce(F.nullif(at("processing_profile"), F.lit("")), F.col("profile")) == profile)
        & (at("regional_product.kind").isNull() | (at("regional_product.kind") == F.col("product")))
        & at("provenance").isNotNull()
        & F.coalesce(at("unresolved"), F.lit("[]")).isin("[]", "null")
    )
    own = municipalities.select(F.col("region_code").alias("_r"), F.col("istat").alias("_i"))
    rows = sources.where(fits)
    municipal = rows.where((F.col("product") == "municipal") & (F.col("territory") == F.col("istat"))).join(own, (F.col("region_code") == F.col("_r")) & (F.col("istat") == F.col("_i")), "left_semi")
    shared = rows.where(F.col("istat").isNull() & F.col("product").isin(*shared_products)).join(own, F.col("region_code") == F.col("_r"), "left_semi")
    return municipal.unionByName(shared)


def reviewed_decisions(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded decisions matched to requests by their hash: same, changed, or request_missing where nothing has that hash any more."""
    now = current.groupBy(F.col("request_hash").alias("_hash")).agg(F.max("decision").alias("now"))
    rows = recorded.join(now, F.col("request_hash") == F.col("_hash"), "left").drop("_hash")
    return rows.withColumn("outcome", F.when(F.col("now").isNull(), "request_missing").when(F.col("now") == F.col("decision"), "same").otherwise("changed"))


def next_stages(runs: DataFrame, stages: list[str]) -> DataFrame:
    """What each version is handed to next: the first stage that has not succeeded, if all before it have; `blocked` where it failed, `running` where it runs.

    A version through with all stages is `done`. Repeated runs of a stage count as its best.
    """
    best = lambda s: F.max(F.when(F.col("stage") == s, F.element_at(F.create_map(*[F.lit(x) for kv in {"succeeded": 3, "running": 2, "failed": 1}.items() for x in kv]), F.col("outcome"))))
    rows = runs.groupBy("version_id").agg(*[F.coalesce(best(s), F.lit(0)).alias(f"_{s}") for s in stages])
    stage, state = F.lit(None).cast("string"), F.lit("done")
    for s in reversed(stages):
        open_ = F.col(f"_{s}") < 3
        stage = F.when(open_, s).otherwise(stage)
        state = F.when(open_, F.when(F.col(f"_{s}") == 2, "running").when(F.col(f"_{s}") == 1, "blocked").otherwise("due")).otherwise(state)
    return rows.select("version_id", stage.alias("stage"), state.alias("state"))
