"""Published notices: what counts as one, paged registers, receipts of verification and counts of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Overflow(ValueError):
    """A register had more pages than may be read; nothing of it is used."""


def bare_url(url: Column) -> Column:
    """A URL without query, fragment and slashes at its end."""
    return F.rtrim(F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), F.lit("/"))


def without_containers(targets: DataFrame, sources: DataFrame, sections: str) -> DataFrame:
    """Targets that are no section of a source. `sections` is a column of JSON, a list of objects with a url."""
    urls = sources.select(F.explode(F.from_json(sections, "array<struct<url:string>>")).alias("s")).select(bare_url(F.col("s.url")).alias("_url")).distinct()
    return targets.withColumn("_bare", bare_url(F.col("url"))).join(urls, F.col("_bare") == F.col("_url"), "left_anti").drop("_bare")


def listed(pages: DataFrame, key: str, most_pages: int) -> DataFrame:
    """The notices of a retained register, each once as the last page that lists it has it; refused if a listing has too many pages.

    `pages` has listing, page and `notices`, an array of structs with the key.
    """
    over = pages.groupBy("listing").agg(F.max("page").alias("last")).where(F.col("last") > most_pages).limit(1).collect()
    if over:
        raise Overflow(f"{over[0]['listing']} has {over[0]['last']} pages")
    rows = pages.select("listing", "page", F.posexplode("notices").alias("place", "notice")).select("listing", "page", "place", "notice.*")
    order = Window.partitionBy("listing", key).orderBy(F.desc("page"), F.desc("place"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "place")


def visible_receipts(receipts: DataFrame, evidence: DataFrame, known_at: Column, most: int) -> DataFrame:
    """Receipts recorded by then whose evidence had all been acquired, at most so many per candidate, with `more` where some are left out."""
    whole = evidence.groupBy("receipt_id").agg(F.bool_and(F.col("acquired_at") <= known_at).alias("_seen")).where("_seen").select("receipt_id")
    rows = receipts.where(F.col("recorded_at") <= known_at).join(whole, "receipt_id", "left_semi")
    order = Window.partitionBy("candidate_id").orderBy("receipt_id")
    place, following = F.row_number().over(order), F.lead("receipt_id").over(order)
    rows = rows.withColumn("_n", place).withColumn("more", (F.col("_n") == most) & following.isNotNull())
    return rows.where(F.col("_n") <= most).drop("_n")


def daily_counts(versions: DataFrame, classified: DataFrame, extracted: DataFrame) -> DataFrame:
    """Of the latest version of each document: all, those not classified and those not extracted."""
    from annalist.operators import asof

    last = asof.latest(versions, ["document_id"], ["acquired_at", "version_id"])
    flag = lambda df, name: df.select("version_id").distinct().withColumn(name, F.lit(True))
    rows = last.join(flag(classified, "_c"), "version_id", "left").join(flag(extracted, "_e"), "version_id", "left")
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("_c").isNull()).alias("unclassified"), F.count_if(F.col("_e").isNull()).alias("unextracted"))
