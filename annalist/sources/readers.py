"""Readers that validate whole files before anything is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Rejected(ValueError):
    """A file was refused as a whole; the message names the reasons."""


def municipalities_csv(spark: SparkSession, path: str) -> DataFrame:
    """istat, name, province from a CSV with a header, all or nothing.

    Refused if a code is not six digits or occurs twice, or a name is empty.
    """
    rows = spark.read.csv(path, header=True, schema="istat string, name string, province string", enforceSchema=False, mode="FAILFAST")
    rows = rows.select(*[F.trim(c).alias(c) for c in rows.columns])
    twice = rows.groupBy("istat").count().where("count > 1").limit(1).count()
    bad = rows.agg(F.count_if(~F.coalesce(F.col("istat").rlike("^[0-9]{6}$"), F.lit(False))), F.count_if(F.coalesce("name", F.lit("")) == ""), F.count("*")).first()
    reasons = [why for n, why in ((bad[0], "codes"), (bad[1], "names"), (twice, "repeated codes"), (not bad[2], "no rows")) if n]
    if reasons:
        raise Rejected(", ".join(reasons))
    return rows


def zones_csv(spark: SparkSession, path: str, municipalities: DataFrame) -> DataFrame:
    """istat, zone, territorial_scope; refused if a municipality is unknown, a pair repeats or one has no zone."""
    rows = spark.read.csv(path, header=True, schema="istat string, zone string, territorial_scope string", enforceSchema=False, mode="FAILFAST")
    unknown = rows.join(municipalities, "istat", "left_anti").limit(1).count()
    absent = municipalities.join(rows, "istat", "left_anti").limit(1).count()
    twice = rows.groupBy("istat", "zone").count().where("count > 1").limit(1).count()
    if unknown or absent or twice:
        raise Rejected(", ".join(why for n, why in ((unknown, "unknown municipalities"), (absent, "municipalities without zone"), (twice, "repeated pairs")) if n))
    return rows


def catalog_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, mode="FAILFAST", multiLine=True)


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Stored objects with their hash; `path` is where they lie."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("object_hash"), F.col("length").alias("size"), "content", "path")
