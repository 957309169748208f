"""Invariants of tables, as named predicates that every row must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _jobs() -> dict[str, Column]:
    state = F.col("state")
    return {
        "lease": (state == "running") == F.col("lease_expires_at").isNotNull(),
        "completion": state.isin("succeeded", "failed") == F.col("completed_at").isNotNull(),
        "error": (state != "failed") | F.col("error_code").isNotNull(),
        "attempts": F.col("attempt_count") <= F.col("max_attempts"),
    }


def _temporal() -> dict[str, Column]:
    precision, known = F.col("precision"), F.col("valid_from").isNotNull()
    return {
        "kind": precision.isin("instant", "date", "interval", "conditional", "unknown"),
        "anchor": precision.isin("unknown", "conditional") | known,
        "end": F.col("valid_until").isNull() | ((precision == "interval") & (F.col("valid_from") < F.col("valid_until"))),
    }


JOBS, TEMPORAL = _jobs, _temporal


def violations(df: DataFrame, invariants) -> DataFrame:
    """Rows that break an invariant, with the sorted names of those they break; an unknown answer breaks it too."""
    rules = invariants()
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in sorted(rules.items())]))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)
