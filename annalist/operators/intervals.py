"""Half-open intervals: overlap, gaps, complement and fixed buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(a: Column, b: Column) -> Column:
    """Whole seconds from a to b."""
    return F.timestamp_diff("SECOND", a, b)


def merged(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Touching and overlapping intervals of each key joined to maximal ones."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.where(F.col(start) < F.col(end)).withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def complement(df: DataFrame, keys: list[str], start: str, end: str, low: Column, high: Column, ignore_seconds: int = 0) -> DataFrame:
    """What [low, high) has left beside a key's intervals; rests of `ignore_seconds` or less are dropped."""
    inside = df.where((F.col(end) > low) & (F.col(start) < high))
    inside = inside.select(*keys, F.greatest(F.col(start), low).alias(start), F.least(F.col(end), high).alias(end))
    edges = df.select(*keys).distinct()
    rows = merged(inside, keys, start, end).unionByName(edges.withColumn(start, high).withColumn(end, high))
    before = F.coalesce(F.lag(end).over(Window.partitionBy(*keys).orderBy(start, end)), low)
    gaps = rows.select(*keys, before.alias("gap_start"), F.col(start).alias("gap_end"))
    return gaps.where(F.col("gap_start") < F.col("gap_end")).where(seconds(F.col("gap_start"), F.col("gap_end")) > ignore_seconds)


def largest_gap(df: DataFrame, keys: list[str], at: str, low: Column, high: Column) -> DataFrame:
    """Seconds of the longest time without an event in [low, high], both ends counted, per key."""
    inside = df.where((F.col(at) >= low) & (F.col(at) <= high)).select(*keys, at)
    before = F.coalesce(F.lag(at).over(Window.partitionBy(*keys).orderBy(at)), low)
    steps = inside.withColumn("_gap", seconds(before, F.col(at)))
    return steps.groupBy(*keys).agg(
        F.greatest(F.max("_gap"), seconds(F.max(at), high)).alias("max_gap_seconds"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n")
    )


def _overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bucket: str) -> DataFrame:
    def dealt(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        start, end = (F.date_trunc(bucket, F.col(c)) for c in span)
        last = F.when(end == F.col(span[1]), end - F.expr(f"INTERVAL 1 {bucket}")).otherwise(end)
        buckets = F.sequence(start, F.greatest(start, last), F.expr(f"INTERVAL 1 {bucket}"))
        return df.where(F.col(span[0]) < F.col(span[1])).withColumn(name, start).withColumn("_bucket", F.explode(buckets))

    rows = dealt(left, left_span, "_l").join(dealt(right, right_span, "_r"), [*keys, "_bucket"])
    overlap = (F.col(left_span[0]) < F.col(right_span[1])) & (F.col(right_span[0]) < F.col(left_span[1]))
    return rows.where(overlap & (F.col("_bucket") == F.greatest("_l", "_r"))).drop("_bucket", "_l", "_r")


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bucket: str = "DAY", coarse: str | None = "MONTH", longest: int = 31
) -> DataFrame:
    """Pairs of equal keys whose intervals overlap.

    Intervals are dealt to the buckets of time that they touch and meet by an equi-join; a pair
    counts in the first bucket that both touch, so it comes out once. Intervals of over `longest` buckets meet
    the others in coarse buckets, so that a long one is not dealt to every short bucket; `coarse` None leaves that out.
    Columns of both sides must differ but for the keys.
    """
    if coarse is None:
        return _overlapping(left, right, keys, left_span, right_span, bucket)
    long = lambda span: F.col(span[1]) > F.col(span[0]) + F.expr(f"INTERVAL {longest} {bucket}")
    short_left, short_right = left.where(~long(left_span)), right.where(~long(right_span))
    parts = [
        _overlapping(short_left, short_right, keys, left_span, right_span, bucket),
        _overlapping(left.where(long(left_span)), right, keys, left_span, right_span, coarse),
        _overlapping(short_left, right.where(long(right_span)), keys, left_span, right_span, coarse),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def buckets(df: DataFrame, at: str, low: Column, high: Column, step_seconds: int, aggregates: list[Column]) -> DataFrame:
    """Aggregates per bucket of [low, high), with a row for buckets in which nothing happened."""
    spark = df.sparkSession
    place = F.floor(seconds(low, F.col(at)) / step_seconds)
    found = df.where((F.col(at) >= low) & (F.col(at) < high)).groupBy(place.cast("long").alias("_n")).agg(*aggregates)
    n = F.ceil(seconds(low, high) / step_seconds).cast("long")
    every = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("_n"))
    start = low + F.make_dt_interval(secs=F.col("_n") * step_seconds)
    return every.join(found, "_n", "left").select(start.alias("bucket"), *[F.col(c) for c in found.columns if c != "_n"])
