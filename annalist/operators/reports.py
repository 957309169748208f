"""Operator reports: job groups, failures, findings, incidents and territorial lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators import asof


def job_groups(jobs: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Per group: jobs by state, due ones, expired leases, the oldest pending and the last finished."""
    state = lambda s: F.col("state") == s
    return jobs.groupBy(*keys).agg(
        F.count_if(state("pending")).alias("pending"),
        F.count_if(state("running")).alias("running"),
        F.count_if(state("succeeded")).alias("succeeded"),
        F.count_if(state("failed")).alias("failed"),
        F.count_if(state("pending") & (F.col("available_at") <= at)).alias("due"),
        F.count_if(state("running") & (F.col("lease_expires_at") <= at)).alias("expired_leases"),
        F.min(F.when(state("pending"), F.col("created_at"))).alias("oldest_pending"),
        F.max("completed_at").alias("last_finished"),
    )


def failure_reasons(jobs: DataFrame, limit: int) -> DataFrame:
    failed = jobs.where(F.col("error_code").isNotNull()).groupBy("queue", "error_code").agg(F.count("*").alias("n"))
    return failed.orderBy(F.desc("n"), "queue", "error_code").limit(limit)


def pending_categories(jobs: DataFrame) -> DataFrame:
    """Versions per source and category, the first that holds of running, failed, waiting, done."""
    flag = lambda s: F.bool_or(F.col("state") == s)
    per_version = jobs.groupBy("source_id", "version_id").agg(
        F.when(flag("running"), "running").when(flag("failed"), "failed").when(flag("pending"), "waiting").otherwise("done").alias("category")
    )
    return per_version.groupBy("source_id", "category").agg(F.count("*").alias("versions"))


def combined(*parts: DataFrame) -> DataFrame:
    """UNION ALL of branches by name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def findings(checks: DataFrame, jobs: DataFrame, at: Column, stale_seconds: int) -> DataFrame:
    """One list of what needs attention: failed checks, stale sources, failed jobs and expired leases."""
    late = F.timestamp_diff("SECOND", F.max("at"), at) > stale_seconds
    last = asof.latest(checks, ["source_id"], ["at", "check_id"])
    return combined(
        last.where(~F.col("complete")).select(F.lit("check_failed").alias("kind"), F.col("source_id").cast("string").alias("subject"), F.col("at").alias("since")),
        checks.groupBy("source_id").agg(F.max("at").alias("since"), late.alias("_late")).where("_late").select(F.lit("source_stale").alias("kind"), F.col("source_id").cast("string").alias("subject"), "since"),
        jobs.where("state = 'failed'").select(F.lit("job_failed").alias("kind"), F.col("job_id").cast("string").alias("subject"), F.col("completed_at").alias("since")),
        jobs.where((F.col("state") == "running") & (F.col("lease_expires_at") <= at)).select(F.lit("lease_expired").alias("kind"), F.col("job_id").cast("string").alias("subject"), F.col("lease_expires_at").alias("since")),
    )


def incident_signals(checks: DataFrame, jobs: DataFrame, at: Column, window_seconds: int, most_failures: int) -> DataFrame:
    """Per category and scope: whether it is active, how many failures count, and when it last recovered."""
    recent = F.timestamp_diff("SECOND", F.col("at"), at).between(0, window_seconds)
    failing = F.count_if(recent & ~F.col("complete"))
    sources = checks.where(F.col("at") <= at).groupBy(F.col("source_id").cast("string").alias("scope")).agg(
        F.lit("source").alias("category"), (failing > most_failures).alias("active"), failing.alias("failures"), F.max(F.when(F.col("complete"), F.col("at"))).alias("recovered_at")
    )
    failed = F.count_if(F.col("state") == "failed")
    queues = jobs.groupBy(F.col("queue").alias("scope")).agg(
        F.lit("queue").alias("category"), (failed > most_failures).alias("active"), failed.alias("failures"), F.max(F.when(F.col("state") == "succeeded", F.col("completed_at"))).alias("recovered_at")
    )
    return combined(sources, queues)


def ordered_history(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Events of each key in order of the fields, as one JSON array."""
    return df.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("history"))


def scope_fingerprint(df: DataFrame, fields: list[str], digits: int = 2) -> DataFrame:
    """One hash of all rows, whatever their order, for tables of a publication scope.

    Hashes of rows are put together in order inside each group of equal first digits, and then the groups' hashes, so no task holds all
    rows: 16 ** `digits` groups share them.
    """
    line = F.md5(F.concat_ws("|", *fields))
    rows = df.select(line.alias("_line"), F.substring(line, 1, digits).alias("_group"))
    groups = rows.groupBy("_group").agg(F.md5(F.array_join(F.array_sort(F.collect_list("_line")), ";")).alias("_hash"), F.count("*").alias("_n"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_group", "_hash"))), lambda x: x["_hash"])
    return groups.agg(F.md5(F.array_join(in_order, ";")).alias("fingerprint"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))


def process_digest(configurations: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """sha256 over the sorted identity tuples of each process, parts apart by a zero character."""
    parts = F.array_sort(F.collect_set(F.concat_ws("\0", *fields)))
    return configurations.groupBy(*keys).agg(F.sha2(F.array_join(parts, "\0"), 256).alias("digest"))


def archived_before(jobs: DataFrame, cutoff: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """The jobs with finished ones from before the cutoff archived, and the count per state."""
    moves = F.col("state").isin("succeeded", "failed") & (F.col("completed_at") < cutoff) & F.col("archived_at").isNull()
    rows = jobs.withColumn("archived_at", F.when(moves, at).otherwise(F.col("archived_at")))
    return rows, jobs.where(moves).groupBy("state").agg(F.count("*").alias("archived"))


def two_days(values: DataFrame, midnight: Column) -> DataFrame:
    """Facts dealt to today and tomorrow from a local midnight, or to undated ones whose time is not known."""
    known = F.col("precision").isin("instant", "interval", "date") & F.col("valid_from").isNotNull()
    begin = [midnight + F.expr(f"INTERVAL {i} DAY") for i in range(3)]

    def within(low: Column, high: Column) -> Column:
        span = F.col("valid_until").isNull() | (F.col("valid_until") > low)
        return known & (F.col("valid_from") < high) & (((F.col("precision") == "interval") & span) | ((F.col("precision") != "interval") & (F.col("valid_from") >= low)))

    days = F.array(F.when(within(*begin[:2]), "today"), F.when(within(*begin[1:]), "tomorrow"), F.when(~known, "undated"))
    # what touches neither day goes before whatever the values are joined with, and they are read once
    return values.where(~known | within(begin[0], begin[2])).withColumn("day", F.explode(F.array_compact(days)))


def warning_groups(warnings: DataFrame, at_status: list[str]) -> DataFrame:
    """Warnings of a daily report by period, product, risk and level, with their zones; given statuses are left out."""
    rows = warnings.where(~F.col("status").isin(*at_status))
    return rows.groupBy("valid_from", "valid_until", "product", "risk", "level").agg(F.array_join(F.array_sort(F.collect_set("zone")), ",").alias("zones"), F.count("*").alias("n"))


def target_states(targets: DataFrame, at: Column, unresolved_days: int) -> DataFrame:
    """State of each followed target: ceased, none, ongoing, aged_unresolved or unresolved."""
    age = F.floor(F.timestamp_diff("SECOND", F.col("first_seen"), at) / 86400)
    state = (
        F.when(F.col("withdrawn"), "ceased").when(~F.col("relevant"), "none").when(F.col("measured"), "ongoing")
        .when(age >= unresolved_days, "aged_unresolved").otherwise("unresolved")
    )
    return targets.withColumn("age_days", F.greatest(F.lit(0), age).cast("long")).withColumn("state", state)


def territorial_overview(regions: DataFrame, municipalities: DataFrame, sources: DataFrame, checks: DataFrame) -> DataFrame:
    """Per region: municipalities, enabled ones, sources, sources with a failed last check, and the last result."""
    m = municipalities.groupBy("region").agg(F.count("*").alias("municipalities"), F.count_if("enabled").alias("enabled"))
    last = asof.latest(checks, ["source_id"], ["at", "check_id"]).select("source_id", "complete", "at")
    s = sources.join(last, "source_id", "left").groupBy("region").agg(F.count("*").alias("sources"), F.count_if(~F.col("complete")).alias("issues"), F.max("at").alias("last_result"))
    zero = {c: 0 for c in ("municipalities", "enabled", "sources", "issues")}
    return regions.join(m, "region", "left").join(s, "region", "left").fillna(zero)


def history_with_association(events: DataFrame, associations: DataFrame) -> DataFrame:
    """Events with the region and municipality their source was associated with at the time."""
    return asof.as_of_join(events, associations, ["source_id"], "at", "recorded_at", ["id"], {"region": "region", "istat": "istat"})


def capped_references(references: DataFrame, most: int) -> DataFrame:
    """At most so many references per version, in order of place."""
    order = Window.partitionBy("version_id").orderBy("place", "reference")
    return references.withColumn("ordinal", F.row_number().over(order)).where(F.col("ordinal") <= most)
