"""Measures, their relations and their phases at a pair of clocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import temporal
from annalist.operators import asof

USABLE = ("supported", "partial", "unreliable")


def selected(measures: DataFrame, suspensions: DataFrame, known_at: Column) -> DataFrame:
    """Measures to show at `known_at`.

    Visible by both clocks of knowledge, from the last extraction of their version, not replaced by
    an equivalent later version that has measures, and with a usable latest interpretation.
    """
    seen = asof.known(measures, suspensions, known_at)
    last = asof.latest(seen.select("version_id", "extraction_id").distinct(), ["version_id"], ["extraction_id"])
    seen = seen.join(last, ["version_id", "extraction_id"], "left_semi")
    later = asof.replaced_by_later(seen, ["document_id", "fingerprint"], ["acquired_at", "version_id"], F.col("fingerprint").isNotNull())
    return later.where((~F.col("replaced") | F.col("fingerprint").isNull()) & F.col("state").isin(*USABLE)).drop("replaced")


def with_status(measures: DataFrame, updates: DataFrame, evaluated_at: Column) -> DataFrame:
    """Status by validity at `evaluated_at`; superseded once an update applied by then, or by the row's cutoff if that is earlier."""
    limit = F.least(evaluated_at, F.col("cutoff"))
    applied = updates.groupBy(F.col("target_id").alias("_target")).agg(F.min("applied_at").alias("_applied"))
    rows = measures.join(applied, F.col("measure_id") == F.col("_target"), "left")
    own = temporal.status(F.col("precision"), F.col("valid_from"), F.col("valid_until"), evaluated_at)
    return rows.withColumn("status", F.when(F.col("_applied") <= limit, "superseded").otherwise(own)).drop("_target", "_applied")


def relations(updates: DataFrame, limit: Column) -> DataFrame:
    """Neighbours of each measure along applied updates, in both directions and in order."""
    applied = updates.where(F.col("applied_at") <= limit)
    out = applied.select(F.col("update_id").alias("measure_id"), F.lit("updates").alias("direction"), F.col("target_id").alias("other"), "applied_at")
    back = applied.select(F.col("target_id").alias("measure_id"), F.lit("updated_by").alias("direction"), F.col("update_id").alias("other"), "applied_at")
    listed = F.array_sort(F.collect_list(F.struct("applied_at", "direction", "other")))
    return out.union(back).groupBy("measure_id").agg(listed.alias("relations"))


def temporal_value(values: DataFrame, entity: str, meaning: str, cutoff: Column) -> DataFrame:
    """The latest value of one meaning for each entity of a kind, as recorded by its owner's cutoff."""
    rows = values.where((F.col("entity_kind") == entity) & (F.col("meaning") == meaning) & (F.col("created_at") <= cutoff))
    return asof.latest(rows, ["entity_id"], ["created_at", "id"])


def owned(values: DataFrame, parents: dict[str, DataFrame], kind: str = "entity_kind", entity: str = "entity_id") -> DataFrame:
    """Values with the source that owns their entity, by one join on (kind, id); `parents` gives entity_id and source_id for each kind."""
    tagged = reduce(DataFrame.union, [df.select(F.lit(name).alias("_kind"), F.col("entity_id").alias("_id"), "source_id") for name, df in parents.items()])
    return values.join(tagged, (F.col(kind) == F.col("_kind")) & (F.col(entity) == F.col("_id")), "left").drop("_kind", "_id")


def owned_value(values: DataFrame, parents: dict[str, DataFrame], suspensions: DataFrame, meaning: str, known_at: Column) -> DataFrame:
    """The latest value of one meaning of each entity, as recorded by the cutoff of the source that owns it; `unknown` has no value by then."""
    frozen = asof.cutoffs(suspensions, known_at).withColumnRenamed("source_id", "_source")
    rows = owned(values.where(F.col("meaning") == meaning), parents).join(frozen, F.col("source_id") == F.col("_source"), "left")
    seen = rows.where(F.col("created_at") <= F.least(known_at, F.col("_frozen"))).drop("_source", "_frozen")
    entities = values.where(F.col("meaning") == meaning).select("entity_kind", "entity_id").distinct()
    return entities.join(asof.latest(seen, ["entity_kind", "entity_id"], ["created_at", "id"]), ["entity_kind", "entity_id"], "left").withColumn("precision", F.coalesce("precision", F.lit("unknown")))


def is_current(records: DataFrame, projections: DataFrame, known_at: Column) -> DataFrame:
    """Records with `current`: whether one of their logical keys is projected to them at `known_at`. Those never mapped by then are current."""
    by_then = projections.where(F.col("created_at") <= known_at)
    last = asof.latest(by_then, ["entity_kind", "source_id", "logical_key"], ["created_at", "id"]).select(F.col("entity_kind").alias("_k"), F.col("record_id").alias("_r")).distinct()
    mapped = by_then.select(F.col("entity_kind").alias("_mk"), F.col("record_id").alias("_mr")).distinct()
    rows = records.join(last, (F.col("entity_kind") == F.col("_k")) & (F.col("record_id") == F.col("_r")), "left")
    rows = rows.join(mapped, (F.col("entity_kind") == F.col("_mk")) & (F.col("record_id") == F.col("_mr")), "left")
    return rows.withColumn("current", F.col("_mr").isNull() | F.col("_r").isNotNull()).drop("_k", "_r", "_mk", "_mr")


def phases(rows: DataFrame, suspensions: DataFrame, projections: DataFrame, validity: DataFrame, known_at: Column, evaluated_at: Column) -> DataFrame:
    """Operational phases visible and current at `known_at`, with the validity last stated for them, its status, and whether their source is to be trusted.

    A phase is recorded by its source's cutoff and acquired by `known_at`. Without a stated validity it is unknown.
    """
    seen = is_current(asof.known(rows, suspensions, known_at).withColumn("entity_kind", F.lit("operational_phase")), projections, known_at).where("current")
    stated = validity.where((F.col("entity_kind") == "operational_phase") & (F.col("meaning") == "validity"))
    stated = stated.join(seen.select(F.col("record_id").alias("entity_id"), "cutoff"), "entity_id").where(F.col("created_at") <= F.col("cutoff"))
    last = asof.latest(stated, ["entity_id"], ["created_at", "id"]).select(F.col("entity_id").alias("record_id"), "precision", "valid_from", "valid_until")
    out = seen.join(last, "record_id", "left").withColumn("precision", F.coalesce("precision", F.lit("unknown")))
    spoilt = suspensions.where(F.col("suspended_at") <= known_at).groupBy(F.col("source_id").alias("_source")).agg(F.max("suspended_at").alias("_last"))
    out = out.join(spoilt, F.col("source_id") == F.col("_source"), "left").withColumn("reliable", F.coalesce(F.col("_last") < F.col("recorded_at"), F.lit(True)))
    status = temporal.status(F.col("precision"), F.col("valid_from"), F.col("valid_until"), evaluated_at)
    return out.withColumn("status", status).drop("_source", "_last", "current", "entity_kind")


def evidence(measures: DataFrame, passages: DataFrame, acts: DataFrame, versions: DataFrame) -> DataFrame:
    """What each measure rests on, in order: its passages, or its document where it has none; then the acts that clarified it by its cutoff, by their official link."""
    own = passages.join(measures.select("measure_id"), "measure_id").select("measure_id", F.lit(1).alias("part"), F.col("ordinal").cast("long").alias("place"), "url", "locator", "passage")
    bare = measures.join(own.select("measure_id").distinct(), "measure_id", "left_anti").join(versions.select("version_id", "url"), "version_id")
    bare = bare.select("measure_id", F.lit(1).alias("part"), F.lit(0).cast("long").alias("place"), "url", F.lit("retained source document").alias("locator"), F.lit(None).cast("string").alias("passage"))
    told = acts.where("outcome = 'clarified'").join(measures.select("measure_id", "cutoff"), "measure_id").where(F.col("recorded_at") <= F.col("cutoff"))
    name = F.concat(F.lit("referenced_act:"), F.col("kind"), F.coalesce(F.concat(F.lit(" "), F.col("act_number"), F.lit("/"), F.col("act_year")), F.lit("")))
    order = Window.partitionBy("measure_id").orderBy("recorded_at", "id", "passage")
    told = told.select("measure_id", F.lit(2).alias("part"), F.row_number().over(order).cast("long").alias("place"), F.coalesce("detail_url", "resource_url").alias("url"), name.alias("locator"), "passage")
    parts = own.union(bare).union(told)
    return parts.withColumn("ordinal", F.row_number().over(Window.partitionBy("measure_id").orderBy("part", "place", "passage", "url"))).drop("part", "place")


def regional(facts: DataFrame, known_at: Column, evaluated_at: Column, history: bool = False) -> DataFrame:
    """Regional facts with status: the newest projection logic of a record, and of a source's product the newest version unless `history`."""
    rows = facts.where(F.col("recorded_at") <= known_at)
    newest = asof.latest(rows.select("record_id", "projection_logic").distinct(), ["record_id"], ["projection_logic"])
    rows = rows.join(newest, ["record_id", "projection_logic"], "left_semi")
    if not history:
        last = asof.latest(rows.select("source_id", "product", "acquired_at", "version_id").distinct(), ["source_id", "product"], ["acquired_at", "version_id"])
        rows = rows.join(last, ["source_id", "product", "version_id"], "left_semi")
    by_date = temporal.date_status(F.to_date("valid_from"), evaluated_at)
    by_span = temporal.status(F.col("precision"), F.col("valid_from"), F.col("valid_until"), evaluated_at)
    return rows.withColumn("status", F.when(F.col("precision") == "date", by_date).otherwise(by_span))


def filtered(rows: DataFrame, status: str | None = None, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Filters on computed results: a status, and validity that may touch [low, high)."""
    if status:
        rows = rows.where(F.col("status") == status)
    if low is not None or high is not None:
        none = F.lit(None).cast("timestamp")
        touch = temporal.intersects(F.col("precision"), F.col("valid_from"), F.col("valid_until"), none if low is None else low, none if high is None else high)
        rows = rows.where(touch)
    return rows


def newer_warnings(measures: DataFrame, versions: DataFrame, reuse: DataFrame, known_at: Column) -> DataFrame:
    """Measures whose document has a later version that is known, not interpreted and not a verified reuse."""
    open_ = versions.where((F.col("acquired_at") <= known_at) & ~F.col("interpreted")).join(reuse, "version_id", "left_anti")
    last = open_.groupBy(F.col("document_id").alias("_document")).agg(F.max("acquired_at").alias("newer_at"))
    rows = measures.join(last, F.col("document_id") == F.col("_document"))
    return rows.where(F.col("newer_at") > F.col("acquired_at")).select("measure_id", "newer_at")


def apply_linked(links: DataFrame, bindings: DataFrame, existing: DataFrame, applied_at: Column) -> DataFrame:
    """Edges for linked runs between bound measures that are not there yet."""
    b = bindings.select("extraction_run_id", "extraction_ordinal", "measure_id")
    update = b.toDF("update_run", "update_ordinal", "update_id")
    target = b.toDF("target_run", "target_ordinal", "target_id")
    edges = links.join(update, ["update_run", "update_ordinal"]).join(target, ["target_run", "target_ordinal"]).select("linking_run_id", "update_id", "target_id", "relation")
    return edges.distinct().join(existing, ["linking_run_id", "update_id", "target_id"], "left_anti").withColumn("applied_at", applied_at)
