"""Document versions: search, chronology, assessment, retention and content identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import temporal
from annalist.operators import asof


def latest_visible(versions: DataFrame, known_at: Column) -> DataFrame:
    return asof.latest(versions.where(F.col("acquired_at") <= known_at), ["document_id"], ["acquired_at", "version_id"])


def search(versions: DataFrame, known_at: Column, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Latest visible version of each document acquired in [low, high)."""
    rows = latest_visible(versions, known_at)
    if low is not None:
        rows = rows.where(F.col("acquired_at") >= low)
    if high is not None:
        rows = rows.where(F.col("acquired_at") < high)
    return rows.orderBy("acquired_at", F.col("version_id").cast("string"))


def chronology(versions: DataFrame, known_at: Column) -> DataFrame:
    """Versions of each document in order, with ordinal, the time until the next, and whether it is the latest."""
    rows = versions.where(F.col("acquired_at") <= known_at)
    order = Window.partitionBy("document_id").orderBy("acquired_at", "version_id")
    following = F.lead("acquired_at").over(order)
    return rows.select("document_id", "version_id", "acquired_at", F.row_number().over(order).alias("ordinal"), following.alias("until"), following.isNull().alias("latest"))


def assessed(versions: DataFrame, extractions: DataFrame, classifications: DataFrame, known_at: Column) -> DataFrame:
    """State of each version by its latest extraction, or by its latest classification if it has none. Of equal times and ids the greatest status counts."""
    pick = lambda df: asof.latest(df.where(F.col("created_at") <= known_at), ["version_id"], ["created_at", "run_id", "status"])
    e = pick(extractions).select("version_id", F.col("status").alias("_extracted"))
    c = pick(classifications).select("version_id", F.col("status").alias("_classified"))
    rows = versions.where(F.col("acquired_at") <= known_at).join(e, "version_id", "left").join(c, "version_id", "left")
    state = F.coalesce("_extracted", F.when(F.col("_classified") == "irrelevant", "irrelevant"), F.when(F.col("_classified").isNotNull(), "pending"), F.lit("unprocessed"))
    return rows.withColumn("state", state).drop("_extracted", "_classified")


def retention_candidates(versions: DataFrame, protected: DataFrame, months: int, at: Column) -> DataFrame:
    """Versions past their calendar age that nothing protects and that are not the latest of their document."""
    last = Window.partitionBy("document_id").orderBy(F.col("acquired_at").desc(), F.col("version_id").desc())
    rows = versions.withColumn("_n", F.row_number().over(last)).withColumn("expires_at", temporal.add_months(F.col("acquired_at"), months))
    return rows.where((F.col("_n") > 1) & (F.col("expires_at") <= at)).drop("_n").join(protected, "version_id", "left_anti")


def without_ancestors(candidates: DataFrame, lineage: DataFrame, all_runs: DataFrame) -> DataFrame:
    """Candidates that no surviving run descends from. `lineage` has run_id and original_run_id."""
    from annalist.operators.lineage import reachable

    survivors = all_runs.join(candidates, "run_id", "left_anti").select("run_id")
    return candidates.join(reachable(lineage, "run_id", "original_run_id", survivors), "run_id", "left_anti")


def fingerprint(text: Column) -> Column:
    """Equality class of a text: case and runs of white space do not count; null has none."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256)


def exact_repeats(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per fingerprint with several rows: how many, and the least key, by partial aggregates only."""
    return df.groupBy(fingerprint(F.col(text)).alias("fingerprint")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def identity(resources: DataFrame) -> DataFrame:
    """Content identity of a version from its resources in order of URL, and whether none required is missing."""
    part = F.struct("url", "role", F.coalesce("object_hash", F.lit("")).alias("object_hash"))
    hashed = F.sha2(F.to_json(F.array_sort(F.collect_list(part))), 256)
    complete = F.bool_and(~F.col("required") | F.col("object_hash").isNotNull())
    return resources.groupBy("version_id").agg(hashed.alias("identity"), complete.alias("complete"))


def earliest_equivalent(runs: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Each run with the earliest finished run of the same stage and fingerprint before it."""
    order = Window.partitionBy("stage", fingerprint).orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first(F.when(F.col("finished"), F.col("run_id")), ignorenulls=True).over(order)
    return runs.withColumn("equivalent", F.when(F.col(fingerprint).isNotNull(), first))


def waiting_equivalent(runs: DataFrame) -> DataFrame:
    """Runs whose class representative, the first of their stage and fingerprint, is not finished."""
    lead = Window.partitionBy("stage", "fingerprint").orderBy("run_id")
    rows = runs.where(F.col("fingerprint").isNotNull()).withColumn("representative", F.first("run_id").over(lead)).withColumn("_done", F.first("finished").over(lead))
    return rows.where((F.col("run_id") != F.col("representative")) & ~F.col("_done")).drop("_done")


def reprocess_selection(versions: DataFrame, source: str | None, low: Column | None, high: Column | None, error: str | None) -> DataFrame:
    """Versions to process again and the name of the selection, a hash of its members."""
    from annalist.operators.paging import optional

    rows = optional(versions, source_id=source, error_code=error)
    rows = rows if low is None else rows.where(F.col("acquired_at") >= low)
    rows = rows if high is None else rows.where(F.col("acquired_at") < high)
    name = rows.agg(F.sha2(F.concat(F.count("*").cast("string"), F.lit(":"), F.coalesce(F.sum(F.xxhash64("version_id").cast("decimal(38,0)")), F.lit(0)).cast("string")), 256).alias("selection_id"))
    return rows.crossJoin(F.broadcast(name))
