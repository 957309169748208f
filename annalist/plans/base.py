"""Registration of queries, and the domain's tables as views of the driver's."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators.shared import dealt, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Source tables and columns of each shape. The expressions mean the same in Spark and in DuckDB.
SHAPES: dict[str, tuple[list[str], list[tuple[str, str]], str]] = {
    "versions": (
        ["orders"],
        [
            ("o_orderkey", "version_id"), ("o_custkey", "document_id"), ("o_custkey % 25", "source_id"), ("o_orderdate", "acquired_at"),
            ("CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus END", "fingerprint"), ("o_orderstatus", "status"), ("o_orderpriority", "priority"),
            ("o_orderstatus = 'F'", "interpreted"), ("CASE WHEN o_totalprice > 300000 THEN 'too_large' END", "error_code"),
        ],
        "",
    ),
    "suspensions": (
        ["orders"],
        [("o_custkey % 25", "source_id"), ("o_orderdate", "suspended_at"), ("CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 60 DAY END", "resumed_at")],
        "o_orderpriority = '1-URGENT' AND o_totalprice > 350000",
    ),
    "measures": (
        ["lineitem", "orders"],
        [
            ("l_orderkey * 10 + l_linenumber", "measure_id"), ("l_orderkey", "version_id"), ("CASE WHEN l_linenumber > 3 THEN 2 ELSE 1 END", "extraction_id"),
            ("o_custkey", "document_id"), ("o_custkey % 25", "source_id"), ("o_orderdate", "acquired_at"), ("CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus END", "fingerprint"),
            ("l_shipdate", "recorded_at"), ("CASE l_returnflag WHEN 'R' THEN 'supported' WHEN 'A' THEN 'partial' ELSE 'rejected' END", "state"),
            ("CASE WHEN l_tax = 0 THEN 'unknown' WHEN l_tax < 0.03 THEN 'instant' WHEN l_tax < 0.05 THEN 'date' ELSE 'interval' END", "precision"),
            ("CASE WHEN l_tax = 0 THEN NULL ELSE l_shipdate END", "valid_from"),
            ("CASE WHEN l_tax >= 0.05 AND l_quantity > 10 THEN l_shipdate + INTERVAL 30 DAY END", "valid_until"),
        ],
        "l_orderkey = o_orderkey",
    ),
    "updates": (
        ["lineitem"],
        [("l_orderkey * 10 + l_linenumber", "update_id"), ("l_orderkey * 10 + 1", "target_id"), ("CASE WHEN l_discount > 0.08 THEN 'replaces' ELSE 'amends' END", "relation"), ("l_shipdate", "applied_at")],
        "l_discount >= 0.07 AND l_linenumber > 1",
    ),
    "attempts": (
        ["lineitem"],
        [
            ("l_orderkey", "run_id"), ("l_linenumber", "number"), ("l_returnflag", "workload"), ("l_linestatus", "stage"), ("l_shipdate", "at"),
            ("CASE WHEN l_tax > 0 THEN CAST(l_quantity AS BIGINT) END", "input_tokens"), ("CAST(round(l_discount * 100) AS BIGINT)", "output_tokens"),
            ("CASE WHEN l_discount > 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END", "cost"), ("CAST(l_quantity AS BIGINT) * 1000", "duration_ms"),
            ("CASE WHEN l_tax > 0.07 THEN 'CHF' ELSE 'EUR' END", "currency"), ("CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'deferred' ELSE 'succeeded' END", "outcome"),
            ("l_orderkey * 10 + l_linenumber", "id"), ("l_suppkey % 10", "price_version_id"),
        ],
        "",
    ),
    "checks": (["events"], [("event_id", "check_id"), ("user_id", "source_id"), ("ts", "at"), ("event_type <> 'error'", "complete"), ("event_type", "kind")], ""),
    "jobs": (
        ["events"],
        [
            ("event_id", "job_id"), ("event_type", "queue"), ("user_id", "source_id"), ("event_id % 100", "version_id"),
            ("CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'pending' END", "state"),
            ("ts", "available_at"), ("ts", "created_at"), ("CASE WHEN event_type = 'view' THEN ts + INTERVAL 1 HOUR END", "lease_expires_at"),
            ("CASE WHEN event_type IN ('purchase', 'error') THEN ts + INTERVAL 10 MINUTE END", "completed_at"),
            ("CASE WHEN event_type = 'error' AND value > 50 THEN 'timeout' WHEN event_type = 'error' THEN 'refused' END", "error_code"),
            ("event_id % 3", "attempt_count"), ("CAST(3 AS BIGINT)", "max_attempts"), ("CAST(NULL AS TIMESTAMP)", "archived_at"),
        ],
        "",
    ),
    "sources": (
        ["customer", "nation"],
        [("c_custkey", "source_id"), ("c_mktsegment", "product"), ("n_name", "territory"), ("n_regionkey", "region"), ("c_acctbal > 0", "enabled"), ("c_acctbal > 8000", "suspended")],
        "c_nationkey = n_nationkey",
    ),
    "acceptances": (
        ["orders"],
        [("o_orderkey", "id"), ("o_custkey", "source_id"), ("o_orderdate", "at"), ("CASE WHEN o_orderstatus = 'O' THEN 'rejected' ELSE 'accepted' END", "decision"), ("o_totalprice > 200000", "limited")],
        "",
    ),
    "regressions": (
        ["orders"],
        [("o_orderkey", "id"), ("o_custkey", "source_id"), ("o_orderdate", "at"), ("o_orderpriority", "suite"), ("o_totalprice < 400000", "passed")],
        "o_orderstatus <> 'F'",
    ),
    "associations": (
        ["orders"],
        [("o_orderkey", "id"), ("o_custkey", "source_id"), ("o_orderdate", "recorded_at"), ("o_orderpriority", "region"), ("o_orderstatus", "istat")],
        "",
    ),
}


def query(sql: str | None = None, shapes: str = ""):
    """Registers a query under its function name, with the SQL that must give the same rows."""

    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            text = shaped(*shapes.split(), then=sql)
            ORACLE_SQL[build.__name__] = re.sub(r"\bat\b", '"at"', text) if shapes else text  # a key word there
        return build

    return register


#: Tables of long texts: work on a row is much more than reading it.
LONG = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in LONG else rows


def dealt_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of short rows with much work on each."""
    return dealt(table(spark, sf_dir, name))


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table made from the driver's tables."""
    tables, columns, where = SHAPES[name]
    df = table(spark, sf_dir, tables[0])
    for other in tables[1:]:
        df = df.join(table(spark, sf_dir, other), F.expr(where))
    if where and len(tables) == 1:
        df = df.where(where)
    return df.selectExpr(*[f"{e.replace('AS TIMESTAMP)', 'AS TIMESTAMP_NTZ)')} AS {n}" for e, n in columns])


def shaped(*names: str, then: str) -> str:
    """SQL with the shapes as common table expressions."""
    parts = []
    for name in names:
        tables, columns, where = SHAPES[name]
        parts.append(f"{name} AS (SELECT {', '.join(f'{e} AS {n}' for e, n in columns)} FROM {', '.join(tables)}{' WHERE ' + where if where else ''})")
    if not parts:
        return then
    body = then.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)}, {body[len('WITH RECURSIVE') if recursive else len('WITH'):]}"
    return f"WITH {', '.join(parts)} {body}"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
