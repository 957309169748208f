"""Exact whole-number cost arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = "9223372036854775807"


def ceil_cost(quantity: Column, price: Column, unit: Column) -> Column:
    """ceil(quantity * price / unit) as a long.

    Null if an input is null or negative, the unit is not positive or the result does not fit.
    A product that fits a long stays one. Else it is a decimal: factors have 19 digits, so products fit in 38; the
    bound is checked before dividing, as whole division wraps silently.
    """
    small = F.try_multiply(quantity, price)
    wide = lambda c: c.cast("decimal(19,0)")
    product, positive = wide(quantity) * wide(price), F.when(unit > 0, wide(unit))
    rest = product % positive
    fits = product <= F.lit(LARGEST).cast("decimal(19,0)") * positive
    cost = F.call_function("div", product - rest, positive).cast("long") + F.when(rest > 0, 1).otherwise(0)
    short = F.call_function("div", small, F.when(unit > 0, unit)) + F.when(small % F.when(unit > 0, unit) > 0, 1).otherwise(0)
    return F.when((quantity >= 0) & (price >= 0) & (unit > 0), F.when(small.isNotNull(), short).when(fits, cost))


def total(values: Column) -> Column:
    """Sum of longs as a long; null if it does not fit."""
    return F.sum(values.cast("decimal(38,0)")).try_cast("long")
