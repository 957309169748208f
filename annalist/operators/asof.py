"""Latest-row, as-of and supersession reads over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _columns(order: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def latest(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key by `order`, nulls last.

    The rank filter lets Spark keep one row per key before the shuffle, so a hot key
    sends one row from each task.
    """
    by = [c.desc_nulls_last() for c in _columns(order)]
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_rank = 1").drop("_rank")


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each key, with their place as `ordinal`."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("ordinal") <= n)


def with_latest(left: DataFrame, right: DataFrame, key: str, right_key: str, order: list[str]) -> DataFrame:
    """Every left row with the latest right row of its key, if there is one."""
    return left.join(latest(right, [right_key], order), F.col(key) == F.col(right_key), "left")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tie: list[str], columns: dict[str, str]) -> DataFrame:
    """Every left row with `columns` of the last right row of its keys at or before its time.

    Both sides share one sort: right rows are carried forward over left rows by a running last value,
    so no pair of rows is formed but the one that is kept. `tie` orders right rows of one time.
    """
    picked = F.struct(*[F.col(c).alias(name) for c, name in columns.items()])
    names = [f"_k{i}" for i in range(len(keys))]
    as_keys = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    ties = F.struct(*[F.col(c) for c in tie])
    rows = right.select(*as_keys, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), ties.alias("_tie"), picked.alias("_right"))
    rows = rows.unionByName(left.select(*as_keys, F.col(left_time).alias("_at"), F.lit(1).alias("_side"), F.struct("*").alias("_left")), allowMissingColumns=True)
    order = Window.partitionBy(*names).orderBy("_at", "_side", F.col("_tie").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("_found", F.last("_right", ignorenulls=True).over(order)).where("_side = 1")
    return joined.select("_left.*", *[F.col(f"_found.{name}").alias(name) for name in columns.values()])


def selected_at(log: DataFrame, kind: str, chosen: str, at: str, tie: str, when: Column) -> DataFrame:
    """For each kind, what the selection log had chosen at `when`."""
    known = log.where(F.col(at) <= when)
    return known.groupBy(kind).agg(F.max_by(chosen, F.struct(at, tie)).alias("selected"), F.max(at).alias("selected_at"))


def cutoffs(suspensions: DataFrame, known_at: Column) -> DataFrame:
    """source_id and the time to which its facts may be read: a suspension open at `known_at` freezes them."""
    suspended = (F.col("suspended_at") <= known_at) & (F.col("resumed_at").isNull() | (F.col("resumed_at") > known_at))
    return suspensions.where(suspended).groupBy("source_id").agg(F.min("suspended_at").alias("_frozen"))


def known(facts: DataFrame, suspensions: DataFrame, known_at: Column, source: str = "source_id", acquired: str = "acquired_at", recorded: str = "recorded_at") -> DataFrame:
    """Facts visible at `known_at`: acquired by then, and recorded by the cutoff of their source."""
    frozen = cutoffs(suspensions, known_at).withColumnRenamed("source_id", "_source")
    rows = facts.where(F.col(acquired) <= known_at).join(frozen, F.col(source) == F.col("_source"), "left")
    rows = rows.withColumn("cutoff", F.least(known_at, F.col("_frozen")))  # least skips nulls
    return rows.where(F.col(recorded) <= F.col("cutoff")).drop("_source", "_frozen")


def replaced_by_later(rows: DataFrame, keys: list[str], order: list[str], replaces: Column) -> DataFrame:
    """Rows with the flag `replaced`: a later row of the same keys replaces them.

    One maximum per class instead of a self join: a class of any size costs its rows once.
    """
    place = F.struct(*order)
    last = F.max(F.when(replaces, place)).over(Window.partitionBy(*keys))
    return rows.withColumn("replaced", F.coalesce(last > place, F.lit(False)))


def carried_forward(rows: DataFrame, keys: list[str], order: list[str], value: str, usable: Column) -> DataFrame:
    """Rows with `presented`: their own value if usable, else the last usable one of an earlier row of the same keys, else their own.

    Rows without a key present their own.
    """
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(usable, F.col(value)), ignorenulls=True).over(earlier)
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    return rows.withColumn("presented", F.when(usable, F.col(value)).otherwise(F.coalesce(F.when(keyed, found), F.col(value))))


def current_projection(projections: DataFrame, keys: list[str], at: str, tie: str, record: str, known_at: Column) -> DataFrame:
    """The record each logical key is projected to at `known_at`."""
    return latest(projections.where(F.col(at) <= known_at), keys, [at, tie]).select(*keys, record)


def insert_if_changed(log: DataFrame, incoming: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Incoming rows whose value differs from the latest in the log; null equals null."""
    last = latest(log, [key], order).select(F.col(key).alias("_key"), F.col(value).alias("_value"), F.lit(True).alias("_seen"))
    rows = incoming.join(last, F.col(key) == F.col("_key"), "left")
    return rows.where(F.col("_seen").isNull() | ~F.col(value).eqNullSafe(F.col("_value"))).drop("_key", "_value", "_seen")
