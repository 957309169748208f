"""Files read and written: imports that are refused as a whole, content by its hash, idempotent appends and updates."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from annalist.operators.shared import scratch
from annalist.plans.base import at, query, shape, table
from annalist.sources import readers, sinks, snapshots


@query("SELECT lpad(n_nationkey::VARCHAR, 6, '0') AS istat, n_name AS name, 'P' || n_regionkey AS province FROM nation")
def municipality_import(spark, sf_dir):
    """Municipalities from a CSV file, all or none."""
    path = scratch(spark, "municipalities")
    rows = table(spark, sf_dir, "nation").selectExpr("lpad(n_nationkey, 6, '0') AS istat", "n_name || ' ' AS name", "'P' || n_regionkey AS province")
    rows.coalesce(1).write.csv(path, header=True)  # 25 rows
    return readers.municipalities_csv(spark, path)


@query("SELECT lpad(n_nationkey::VARCHAR, 6, '0') AS istat, 'Z' || (n_regionkey + k) AS zone, 'whole' AS territorial_scope FROM nation, range(2) AS r(k)")
def zone_import(spark, sf_dir):
    """Pairs of municipality and zone from a CSV file, each municipality with one at least."""
    path = scratch(spark, "zones")
    nations = table(spark, sf_dir, "nation")
    rows = nations.selectExpr("lpad(n_nationkey, 6, '0') AS istat", "explode(array('Z' || n_regionkey, 'Z' || (n_regionkey + 1))) AS zone", "'whole' AS territorial_scope")
    rows.coalesce(1).write.csv(path, header=True)  # 50 rows
    return readers.zones_csv(spark, path, nations.selectExpr("lpad(n_nationkey, 6, '0') AS istat"))


@query("SELECT r_regionkey AS code, r_name AS name FROM region")
def catalog_seed(spark, sf_dir):
    """Regions from a JSON catalog."""
    path = scratch(spark, "catalog")
    table(spark, sf_dir, "region").selectExpr("r_regionkey AS code", "r_name AS name").coalesce(1).write.json(path)  # 5 rows
    return spark.read.json(path, schema="code long, name string", mode="FAILFAST")


@query("SELECT sha256(text) AS object_hash, strlen(any_value(text))::BIGINT AS size, true AS intact FROM documents WHERE text IS NOT NULL GROUP BY 1")
def object_store(spark, sf_dir):
    """Content stored once under its hash, read back and checked."""
    path = scratch(spark, "objects")
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("object_hash"), F.col("text").cast("binary").alias("content"))
    sinks.store_objects(rows, path)
    stored = sinks.stored_objects(spark.read.schema("object_hash string, content binary, prefix string").parquet(path))
    return stored.select("object_hash", F.length("content").cast("long").alias("size"), "intact")


_STAGED = "o_custkey AS document_id, CAST(o_orderpriority AS STRING) AS content_hash, o_orderstatus AS object_hash"


@query("""
WITH s AS (SELECT o_custkey AS document_id, o_orderpriority AS content_hash, bool_and(o_orderstatus <> 'P') AS whole FROM orders GROUP BY 1, 2)
SELECT document_id, content_hash FROM s WHERE whole AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = s.document_id AND o.o_orderpriority = s.content_hash AND o.o_totalprice > 400000)""")
def version_commits(spark, sf_dir):
    """Staged versions whose objects are stored and that are not there yet."""
    orders = table(spark, sf_dir, "orders")
    staged = orders.selectExpr(*_STAGED.split(", ")).groupBy("document_id", "content_hash").agg(F.collect_set("object_hash").alias("object_hashes"))
    versions = orders.where("o_totalprice > 400000").selectExpr("o_custkey AS document_id", "o_orderpriority AS content_hash").distinct()
    stored = orders.where("o_orderstatus <> 'P'").selectExpr("o_orderstatus AS object_hash").distinct()
    return sinks.append_versions(staged, versions, stored).select("document_id", "content_hash")


@query("SELECT o_orderkey AS effect_key, o_orderstatus AS payload FROM orders WHERE o_orderkey % 3 <> 0")
def outbox_effects(spark, sf_dir):
    """Effects that were not sent before, each once however often it is handed in."""
    effects = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS effect_key", "o_orderstatus AS payload")
    return sinks.outbox(effects.where("effect_key % 3 = 0"), effects.union(effects), "effect_key", "payload")


@query("""
SELECT job_id, queue, CASE WHEN job_id % 100 = 7 THEN 'archived' ELSE state END AS state, CASE WHEN job_id % 100 = 7 THEN 'by hand' ELSE error_code END AS error_code FROM jobs""", "jobs")
def update_from(spark, sf_dir):
    """A table after an update by the rows of another."""
    jobs = shape(spark, sf_dir, "jobs").select("job_id", "queue", "state", "error_code")
    updates = jobs.where("job_id % 100 = 7").select("job_id", F.lit("archived").alias("state"), F.lit("by hand").alias("error_code"))
    return sinks.changed(jobs, updates, ["job_id"])


@query("""
SELECT measure_id, (CASE WHEN recorded_at <= TIMESTAMP '1995-06-17' THEN 'then' ELSE 'later' END) AS known FROM measures WHERE acquired_at <= TIMESTAMP '1995-06-17' AND recorded_at <= TIMESTAMP '1996-01-01'""", "measures")
def late_facts(spark, sf_dir):
    """Facts of versions acquired by a day, by whether they were recorded then or came late."""
    rows = shape(spark, sf_dir, "measures").where((F.col("acquired_at") <= at("1995-06-17")) & (F.col("recorded_at") <= at("1996-01-01")))
    return rows.select("measure_id", F.when(F.col("recorded_at") <= at("1995-06-17"), "then").otherwise("later").alias("known"))


@query("""
SELECT 'orders' AS name, count(*) AS n, count(DISTINCT o_custkey) AS customers, sum(o_orderkey)::BIGINT AS keys FROM orders
UNION ALL SELECT 'customer', count(*), count(DISTINCT c_custkey), sum(c_custkey)::BIGINT FROM customer""")
def snapshot_export(spark, sf_dir):
    """Tables published under one manifest of files and hashes, and read again through it."""
    path = scratch(spark, "snapshot")
    snapshots.publish({name: table(spark, sf_dir, name) for name in ("orders", "customer")}, path, datetime.datetime(2026, 1, 1))
    tables = snapshots.read(spark, path)
    count = lambda name, key, customer: tables[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct(customer).alias("customers"), F.sum(key).alias("keys"))
    return count("orders", "o_orderkey", "o_custkey").union(count("customer", "c_custkey", "c_custkey"))
