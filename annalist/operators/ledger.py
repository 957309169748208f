"""Usage and cost over runs and attempts. Unknown is never zero; money is whole microunits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.money import ceil_cost, total
from annalist.operators import asof


def usage_breakdown(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts, retries, unknowns, tokens and cost per group; attempts after the first are retries."""
    retry = F.col("number") > 1
    sums = [total(F.col(c)).alias(c) for c in ("input_tokens", "output_tokens")]
    return attempts.groupBy(*keys).agg(
        F.countDistinct("run_id").alias("runs"),
        F.count("*").alias("attempts"),
        F.count_if(retry).alias("retries"),
        F.count_if(F.col("input_tokens").isNull()).alias("usage_unknown"),
        F.count_if(F.col("cost").isNull()).alias("cost_unknown"),
        *sums,
        total(F.col("cost")).alias("cost"),
        total(F.when(retry, F.col("cost"))).alias("retry_cost"),
    )


def usage_totals(attempts: DataFrame) -> DataFrame:
    """One row over the whole scope; `cost_complete` only if every attempt has a cost."""
    return attempts.agg(
        F.count("*").alias("attempts"),
        total(F.col("input_tokens")).alias("input_tokens"),
        total(F.col("cost")).alias("cost"),
        F.coalesce(F.bool_and(F.col("cost").isNotNull()), F.lit(True)).alias("cost_complete"),
    )


def map_rollup(df: DataFrame, keys: list[str], units: str) -> DataFrame:
    """Sum per key and metric of a map column."""
    rows = df.select(*keys, F.explode(units).alias("metric", "amount"))
    return rows.groupBy(*keys, "metric").agg(F.sum(F.col("amount").cast("decimal(38,0)")).cast("long").alias("amount"))


def as_maps(rolled: DataFrame, keys: list[str]) -> DataFrame:
    """The rollup as one map per key."""
    return rolled.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "amount")))).alias("units"))


def costs(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Cost per usage id from lines (id, price_version_id, metric, amount) and rates.

    Null where a metric has no rate, a rate has no metric, or a line does not fit.
    """
    priced = usage.select("id", "price_version_id").distinct().join(rates, "price_version_id")
    lines = usage.join(priced, ["id", "price_version_id", "metric"], "full")
    cost = ceil_cost(F.col("amount"), F.col("price_microunits"), F.col("unit_size"))
    return lines.groupBy("id").agg(F.when(F.bool_and(cost.isNotNull()), total(cost)).alias("cost"))


def price_assumptions(uses: DataFrame, prices: DataFrame) -> DataFrame:
    """Whether each price version was observed before its first use and in force for all of it."""
    spans = uses.groupBy("price_version_id").agg(F.min("at").alias("first_use"), F.max("at").alias("last_use"), F.count("*").alias("uses"))
    inside = (F.col("effective_from") <= F.col("first_use")) & (F.col("effective_to").isNull() | (F.col("last_use") < F.col("effective_to")))
    return spans.join(prices, "price_version_id", "left").withColumn("valid", F.coalesce(inside & (F.col("observed_at") <= F.col("first_use")), F.lit(False)))


def completeness(present: DataFrame, required: DataFrame, currencies: DataFrame) -> DataFrame:
    """Codes of what a report lacks, sorted: missing metrics, unknown usage or cost, more than one currency."""
    missing = required.join(present, ["category", "workload"], "left_anti").select(F.concat_ws(":", F.lit("metric_missing"), "category", "workload").alias("code"))
    unknown = present.where("usage_unknown > 0").select(F.concat_ws(":", F.lit("usage_unknown"), "category", "workload").alias("code"))
    costless = present.where("cost_unknown > 0").select(F.concat_ws(":", F.lit("cost_unknown"), "category", "workload").alias("code"))
    several = currencies.agg(F.countDistinct("currency").alias("n")).where("n > 1").select(F.lit("currency_mixed").alias("code"))
    return missing.union(unknown).union(costless).union(several).distinct().orderBy("code")


def latest_inputs(inputs: DataFrame) -> DataFrame:
    return asof.latest(inputs, ["category", "workload", "component"], ["revision"])


def monthly_projection(spent: Column, trial_seconds: Column, month_seconds: int = 30 * 24 * 3600) -> Column:
    """What a month costs at the trial's pace, rounded up."""
    return ceil_cost(spent, F.lit(month_seconds).cast("long"), trial_seconds)


def usage_state(calls: DataFrame, keys: list[str]) -> DataFrame:
    """reported if every call has its usage, unavailable if none has, else partial; sums are given only if reported."""
    known, n = F.count("input_tokens"), F.count("*")
    state = F.when(known == n, "reported").when(known == 0, "unavailable").otherwise("partial")
    return calls.groupBy(*keys).agg(state.alias("usage_status"), F.when(known == n, total(F.col("input_tokens"))).alias("input_tokens"))


def evaluation_runs(attempts: DataFrame) -> DataFrame:
    """Per run: attempts, whole duration, unknowns and the set of currencies."""
    return attempts.groupBy("run_id").agg(
        F.count("*").alias("attempts"),
        F.sum("duration_ms").alias("duration_ms"),
        F.count_if(F.col("cost").isNull()).alias("unknown"),
        F.array_join(F.array_sort(F.collect_set("currency")), ",").alias("currencies"),
    )


def regression(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Useful, omitted, unsupported and indeterminate fields, and whether the suite passes: something useful and nothing wrong."""
    count = lambda outcome: F.count_if(F.col("outcome") == outcome)
    wrong = count("omitted") + count("unsupported") + count("indeterminate")
    return outcomes.groupBy(*keys).agg(
        count("useful").alias("useful"), count("omitted").alias("omitted"), count("unsupported").alias("unsupported"), count("indeterminate").alias("indeterminate"),
        ((wrong == 0) & (count("useful") > 0)).alias("passed"),
    )


def variants(results: DataFrame) -> DataFrame:
    """Passed and failed cases of two variants over the documents that both have; the candidate passes without failures."""
    both = results.groupBy("document_id").agg(F.countDistinct("variant").alias("n")).where("n = 2").select("document_id")
    counted = results.join(both, "document_id", "left_semi").groupBy("variant").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    return counted.withColumn("accepted", (F.col("variant") == "candidate") & (F.col("failed") == 0))
