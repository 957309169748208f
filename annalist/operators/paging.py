"""Filters with optional values, and pages of ordered results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def optional(df: DataFrame, **values) -> DataFrame:
    """Keeps rows equal to every value that is set; unset ones (None or '') add no predicate."""
    given = [F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in values.items() if v not in (None, "")]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def offset_page(df: DataFrame, order: list[Column], size: int, page: int) -> DataFrame:
    """One page and whether more follows; one row beyond the page is read."""
    rows = df.orderBy(*order).offset(size * page).limit(size + 1)
    counted = rows.agg(F.collect_list(F.struct("*")).alias("_rows"))  # at most size + 1 rows
    more = F.size("_rows") > size
    return counted.select(F.explode(F.slice("_rows", 1, size)).alias("_row"), more.alias("more")).select("_row.*", "more")


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, size: int, descending: bool = False) -> DataFrame:
    """The next rows behind the key `after`, in key order."""
    if after is not None:
        place, limit = F.struct(*keys), F.struct(*[F.lit(v).alias(k) for v, k in zip(after, keys, strict=True)])
        df = df.where(place < limit if descending else place > limit)
    return df.orderBy(*[F.col(k).desc() if descending else F.col(k).asc() for k in keys]).limit(size)


def ranked(column: Column, values: list[str]) -> Column:
    """Place of a value in a fixed order; others come last."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, values)), column).cast("int"), F.lit(0)) - F.when(column.isin(*values), 1).otherwise(-len(values))


#: Order in which statuses are listed.
STATUS_ORDER = ["current", "undetermined", "future", "expired", "cancelled", "superseded"]
