"""Municipalities, zones and postal codes under a selected dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators import asof


def dataset_at(selections: DataFrame, kind: str, when: Column) -> DataFrame:
    """dataset_id of a kind selected at a time, as one row."""
    return asof.selected_at(selections.where(F.col("kind") == kind), "kind", "dataset_id", "selected_at", "id", when).select(F.col("selected").alias("dataset_id"))


def of_dataset(rows: DataFrame, dataset: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(dataset), "dataset_id", "left_semi")  # one row


def discover(municipalities: DataFrame, dataset: DataFrame, name: str | None = None, istat: str | None = None) -> DataFrame:
    """Candidates and the outcome ok, ambiguous, not_found or unsupported_area; at most one selector."""
    if name and istat:
        raise ValueError("give a name or a code, not both")
    rows = of_dataset(municipalities, dataset)
    if name:
        rows = rows.where(F.lower("name") == name.lower())
    if istat:
        rows = rows.where(F.col("istat") == istat)
    found = F.array_sort(F.collect_list(F.struct("istat", "name", "province", "supported")))
    return rows.agg(found.alias("candidates")).select(outcome(F.col("candidates")).alias("status"), "candidates")


def outcome(candidates: Column) -> Column:
    one = F.get(candidates, 0)
    return F.when(F.size(candidates) == 0, "not_found").when(F.size(candidates) > 1, "ambiguous").when(~one["supported"], "unsupported_area").otherwise("ok")


def lookup_postal(postal: DataFrame, municipalities: DataFrame, dataset: DataFrame, code: str) -> DataFrame:
    """Every municipality of a postal code; a choice is always left to the caller."""
    codes = of_dataset(postal, dataset).where(F.col("postal_code") == code).select(F.col("municipality_istat").alias("istat"))
    return municipalities.join(codes, "istat", "left_semi").select("istat", "name").distinct().withColumn("requires_selection", F.lit(True))


def with_zones(municipalities: DataFrame, mappings: DataFrame, datasets: DataFrame) -> DataFrame:
    """Zones of municipalities, only of mappings made for the registry the municipality is from.

    `datasets` gives dataset_id and parent_id of each mapping. One partial zone makes a mapping partial.
    """
    made = mappings.join(datasets, "dataset_id").select(F.col("parent_id").alias("dataset_id"), F.col("municipality_istat").alias("istat"), "ordinal", "zone", "territorial_scope")
    zones = made.groupBy("dataset_id", "istat").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "zone"))), lambda x: x["zone"]).alias("zones"),
        F.when(F.bool_or(F.col("territorial_scope") == "partial"), "partial").otherwise("whole").alias("scope"),
    )
    return municipalities.join(zones, ["dataset_id", "istat"], "left")


def source_allowed(sources: DataFrame, associations: DataFrame, regions: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Whether a source may run: its current association, region and municipality are all enabled; without an association it may."""
    now = asof.latest(associations, ["source_id"], ["recorded_at", "id"])
    rows = sources.join(now.select("source_id", "region", "istat"), "source_id", "left")
    rows = rows.join(regions.select("region", F.col("enabled").alias("_r")), "region", "left").join(municipalities.select("istat", F.col("enabled").alias("_m")), "istat", "left")
    allowed = F.col("region").isNull() | (F.coalesce("_r", F.lit(False)) & (F.col("istat").isNull() | F.coalesce("_m", F.lit(False))))
    return rows.select("source_id", allowed.alias("allowed"))
