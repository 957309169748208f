"""Mixing sources to target weights by capped water-filling. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm import shared

#: Ranges of the seeded hash into which each source is cut to find where its fraction ends.
BUCKET_BITS = 12
#: Source tables of up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 50_000


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which min(cap, level * weight) sums to `total`.

    Clamps every source above its cap and shares what is left by the weights of the rest,
    until none is above. Only two sums a round come to the driver.
    """
    weights = sources.agg(F.sum("weight")).first()[0]
    level = total / weights if weights else 0.0
    while True:
        above = F.lit(level) * F.col("weight") > F.col("cap")
        caps, rest = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        raised = (total - caps) / rest if rest else level
        if raised <= level:
            return level
        level = raised


def _words(size: Column | None) -> Column:
    return F.coalesce(size if size is not None else F.regexp_count("text", F.lit(shared.WORD)), F.lit(0)).cast("long")


def _place(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"))


def plan(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: int, size: Column | None) -> tuple[DataFrame, DataFrame, bool]:
    """The rows (doc_id, source, size, place), a row per source, and whether the sources are few.

    A source has source_size, target, whole, quota (words wanted beyond whole repetitions), end (the
    place in which the quota ends), part (words of the quota that fall on it) and end_n (words there).
    """
    bucket = F.shiftright("place", 64 - BUCKET_BITS).cast("int")
    rows = shared.written(docs.select("doc_id", "source", _words(size).alias("size"), _place(seed).alias("place")), "mix-rows")
    buckets = shared.written(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n")), "mix-buckets")
    sizes = shared.written(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), "mix-sizes")
    n_sources, total = sizes.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    few, order = n_sources <= BROADCAST_SOURCES, F.col("source").asc_nulls_last()
    if few:  # one task numbers so many rows
        sizes = sizes.withColumn("row_number", F.row_number().over(Window.orderBy(order)) - 1)
    else:
        sizes, _ = shared.numbered(sizes, [order], "mix-order")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("row_number", F.lit(len(weights))) + 1).cast("int"))
    sources = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs).drop("row_number")
    sources = shared.written(sources, "mix-sources")
    level = water_level(sources, total)

    share = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    quota = F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long")
    sources = sources.withColumn("target", share).withColumn("whole", whole).withColumn("quota", quota)

    # the bucket, then the place, at which the cumulated words of a source reach its quota
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = with_source(buckets.withColumn("before", before), sources, few, "quota")
    ends = ends.where("before <= quota AND quota < before + n").select("source", F.col("bucket").alias("end_bucket"), (F.col("quota") - F.col("before")).alias("left"))
    inside = with_source(rows, ends, few, "end_bucket", "left").where(bucket == F.col("end_bucket"))
    inside = inside.groupBy("source", "place").agg(F.sum("size").alias("n"), F.first("left").alias("left"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("before", before).where("before <= left AND left < before + n")
    ends = inside.select("source", F.col("place").alias("end"), (F.col("left") - F.col("before")).alias("part"), F.col("n").alias("end_n"))
    return rows, shared.written(with_source(sources, ends, few, "end", "part", "end_n", how="left"), "mix-plan"), few


def with_source(df: DataFrame, sources: DataFrame, few: bool, *columns: str, how: str = "inner") -> DataFrame:
    """`df` with columns of its source; null is a source as well."""
    own = sources.select(F.col("source").alias("_source"), *columns)
    return df.join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


#: Words that a row adds beyond its whole repetitions.
EXTRA = """
CASE WHEN quota = 0 THEN 0L
     WHEN end IS NULL OR {place} < end THEN {size}
     WHEN {place} = end THEN part * {size} div end_n
     ELSE 0L END"""
CHOICE = ("whole", "quota", "end", "part", "end_n")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17, size: Column | None = None) -> DataFrame:
    """How much of each document the mix takes.

    Returns one row per input row: doc_id, source, size (words), source_size, target, taken,
    whole (repetitions that every document of the source gets), extra (words taken besides).

    Sources in code point order, null last, weigh `weights` in turn, and share the words of the
    whole table; a source stops at `max_epochs` times its size and the excess goes to the rest.
    A source's target is made of whole repetitions of all its documents and, for the fraction,
    of one more of the documents that come first by a seeded hash of doc_id. The document in
    which the fraction ends is taken in part, so a source's taken words are within a word per
    repeated row of its target. Rows with one doc_id share their place and are treated alike.

    Null or empty text: size 0, taken 0. Null source: a source of its own. Null doc_id: hashed
    as such. Empty table: no rows. Other columns are ignored. Of a very long text only the number of words is kept.
    """
    rows, sources, few = plan(docs, weights, max_epochs, seed, size)
    taken = with_source(rows, sources, few, "source_size", "target", *CHOICE).withColumn("extra", F.expr(EXTRA.format(place="place", size="size")))
    return taken.select("doc_id", "source", "size", "source_size", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17, size: Column | None = None) -> DataFrame:
    """The documents repeated as the mix takes them, with the columns of the input.

    Whole documents only: the one in which a source's fraction ends is taken once more if at
    least half of it is wanted. Documents without words are never taken. Texts are not shuffled:
    each row meets the row of its source and decides for itself.
    """
    _, sources, few = plan(docs, weights, max_epochs, seed, size)
    rows = docs.select(F.struct("*").alias("_row"), "source", _words(size).alias("_size"), _place(seed).alias("_place"))
    chosen = with_source(rows, sources, few, *CHOICE).withColumn("_extra", F.expr(EXTRA.format(place="_place", size="_size")))
    times = F.col("whole") + F.when(F.col("_extra") * 2 >= F.col("_size"), 1).otherwise(0)
    copies = chosen.where("_size > 0").withColumn("_times", times).where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    return copies.select("_row.*")


def op3_source_mixing(spark, sf_dir):
    """What a mix of the size of all documents takes of each; see `mix`."""
    return mix(shared.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
