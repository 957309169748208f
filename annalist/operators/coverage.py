"""Coverage, quality, observation and acceptance of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import temporal
from annalist.operators import asof, intervals


def accepted(acceptances: DataFrame, regressions: DataFrame) -> DataFrame:
    """Sources whose latest acceptance was accepted, with no failed regression since."""
    last = asof.latest(acceptances, ["source_id"], ["at", "id"]).where(F.col("decision") == "accepted").select("source_id", F.col("at").alias("accepted_at"))
    failed = regressions.where(~F.col("passed")).select(F.col("source_id").alias("_s"), F.col("at").alias("_failed"))
    since = (F.col("source_id") == F.col("_s")) & (F.col("_failed") >= F.col("accepted_at"))
    return last.join(failed, since, "left_anti")


def coverage_state(sources: DataFrame, accepted_sources: DataFrame, keys: list[str]) -> DataFrame:
    """enabled, suspended or pending per group: the best state any of its sources has."""
    rows = sources.join(accepted_sources.select("source_id", F.lit(True).alias("_ok")), "source_id", "left")
    live = F.coalesce(F.col("_ok"), F.lit(False)) & F.col("enabled")
    state = F.when(F.bool_or(live & ~F.col("suspended")), "enabled").when(F.bool_or(live & F.col("suspended")), "suspended").otherwise("pending")
    return rows.groupBy(*keys).agg(state.alias("state"), F.count("*").alias("sources"))


def updating(checks: DataFrame, delay_seconds: int, at: Column) -> DataFrame:
    """Updating state of each source from its checks."""
    seen = checks.where(F.col("at") <= at)
    rows = seen.groupBy("source_id").agg(F.max(F.when(F.col("complete"), F.col("at"))).alias("last_complete"), F.max_by("complete", F.struct("at", "check_id")).alias("_last"))
    state = temporal.updating_state(F.col("last_complete"), ~F.col("_last"), F.lit(False), delay_seconds, at)
    return rows.select("source_id", "last_complete", state.alias("state"))


def history_start(versions: DataFrame, keys: list[str], requested: Column) -> DataFrame:
    """First acquisition in scope, and whether what was asked for begins earlier."""
    return versions.groupBy(*keys).agg(F.min("acquired_at").alias("history_start")).withColumn("gap", requested < F.col("history_start"))


def source_report(checks: DataFrame, low: Column, high: Column, most_gap: int, least_days: int) -> DataFrame:
    """Per source: checks, complete and failed ones, local days, the longest gap, and issue codes."""
    inside = checks.where((F.col("at") >= low) & (F.col("at") <= high))
    gaps = intervals.largest_gap(checks, ["source_id"], "at", low, high).select("source_id", "max_gap_seconds")
    counts = inside.groupBy("source_id").agg(
        F.count("*").alias("checks"),
        F.count_if("complete").alias("complete"),
        F.count_if(~F.col("complete")).alias("failed"),
        F.countDistinct(temporal.local_day(F.col("at"))).alias("local_days"),
    )
    issue = lambda condition, code: F.when(condition, F.lit(code))
    codes = F.array_compact(F.array(issue(F.col("max_gap_seconds") > most_gap, "gap"), issue(F.col("local_days") < least_days, "days"), issue(F.col("complete") == 0, "never_complete")))
    return counts.join(gaps, "source_id").withColumn("issues", F.array_join(codes, ","))


def campaign(reports: DataFrame, products: DataFrame, over: Column) -> DataFrame:
    """running until the end; then complete, or extended while a source has issues or a product none."""
    missing = products.join(reports.select("product").distinct(), "product", "left_anti")
    issues = reports.where("issues <> ''").select(F.col("source_id").cast("string").alias("what")).union(missing.select(F.concat(F.lit("product:"), "product")))
    found = issues.agg(F.count("*").alias("open_issues"))
    return found.withColumn("status", F.when(~over, "running").when(F.col("open_issues") > 0, "extended").otherwise("complete"))


def level_summary(levels: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The highest level of each group by the fixed order (highest first), and whether any zone differs."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("level")), F.lit(0)), F.lit(len(order) + 1))
    best = F.min_by("level", rank)
    return levels.groupBy(*keys).agg(best.alias("level"), (F.countDistinct("level") > 1).alias("partial_territory"), F.count("*").alias("zones"))


def release_readiness(required: DataFrame, reviews: DataFrame, regressed: DataFrame) -> DataFrame:
    """Per required (product, territory): pending, accepted_declared_scope or accepted_with_limitations, by the latest unregressed review of each source."""
    last = asof.latest(reviews, ["source_id"], ["at", "id"]).join(regressed, "source_id", "left_anti").where(F.col("decision") == "accepted")
    scopes = last.groupBy("product", "territory").agg(F.bool_or(~F.col("limited")).alias("_whole"))
    state = F.when(F.col("_whole").isNull(), "pending").when(F.col("_whole"), "accepted_declared_scope").otherwise("accepted_with_limitations")
    return required.join(scopes, ["product", "territory"], "left").select("product", "territory", state.alias("status"))


def overall_readiness(scopes: DataFrame) -> DataFrame:
    waiting, n = F.count_if(F.col("status") == "pending"), F.count("*")
    return scopes.agg(F.when(waiting == n, "pending").when(waiting > 0, "partial").otherwise("ready").alias("overall"), waiting.alias("pending"), n.alias("scopes"))


def regression_ready(regressions: DataFrame) -> DataFrame:
    """Sources of whose suites the latest run passed each."""
    return asof.latest(regressions, ["source_id", "suite"], ["at", "id"]).groupBy("source_id").agg(F.bool_and("passed").alias("ready"))


def compared(candidate: DataFrame, other: DataFrame, identity: list[str], fields: list[str]) -> DataFrame:
    """Per record, corroboration by another channel: identity must agree, then each field is compared.

    A conflict in any field dominates; a record without a partner is missing.
    """
    right = other.select("record_id", *[F.col(c).alias(f"_{c}") for c in [*identity, *fields]], F.lit(True).alias("_there"))
    rows = candidate.join(right, "record_id", "left")
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    outcome = lambda c: F.when(F.col(c).isNull() | F.col(f"_{c}").isNull(), "missing").when(F.col(c) == F.col(f"_{c}"), "corroborated").otherwise("conflict")
    found = F.array(*[outcome(c) for c in fields])
    state = (
        F.when(F.col("_there").isNull(), "missing").when(~same, "non_comparable")
        .when(F.array_contains(found, "conflict"), "conflict").when(F.array_contains(found, "corroborated"), "corroborated").otherwise("missing")
    )
    return rows.select("record_id", state.alias("state"), F.array_join(found, ",").alias("fields"))
