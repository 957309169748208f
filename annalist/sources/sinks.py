"""Idempotent writes to append-only Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Conflict(ValueError):
    """A key was written before with other content."""


def new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not there yet, one per key (insert, or nothing on conflict)."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def merged(existing: DataFrame, incoming: DataFrame, keys: list[str], merge: dict[str, Column] | None = None) -> DataFrame:
    """Insert or update: a column takes the incoming value where it is set, or what `merge` makes of it.

    Expressions of `merge` see the columns as `old_<name>` and `new_<name>`.
    """
    columns = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, *[F.col(c).alias(f"old_{c}") for c in columns])
    new = incoming.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns])
    values = {c: (merge or {}).get(c, F.coalesce(F.col(f"new_{c}"), F.col(f"old_{c}"))).alias(c) for c in columns}
    return old.join(new, keys, "full").select(*[F.col(c) if c in keys else values[c] for c in existing.columns])


def outbox(existing: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """New effects; refused if an effect's key is there with other content."""
    hashed = F.sha2(F.col(content), 256)
    before = existing.select(F.col(key).alias("_key"), hashed.alias("_hash"))
    clash = incoming.join(before, F.col(key) == F.col("_key")).where(hashed != F.col("_hash")).select(key).limit(1).collect()
    if clash:
        raise Conflict(str(clash[0][0]))
    return new_rows(existing, incoming, [key])


def append_versions(staged: DataFrame, versions: DataFrame, stored: DataFrame) -> DataFrame:
    """Staged versions whose objects are all stored and whose (document, content) is new."""
    missing = staged.select("document_id", "content_hash", F.explode("object_hashes").alias("object_hash")).join(stored.select("object_hash"), "object_hash", "left_anti")
    whole = staged.join(missing, ["document_id", "content_hash"], "left_anti")
    return new_rows(versions, whole, ["document_id", "content_hash"])


def changed(existing: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """The table after an update from another: columns of `updates` replace those of the row of their key; keys that are not there are left out."""
    columns = [c for c in updates.columns if c not in keys]
    new = updates.select(*keys, F.struct(*columns).alias("_new"))
    rows = existing.join(new, keys, "left")
    given = F.col("_new").isNotNull()
    return rows.select(*[F.when(given, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in existing.columns])


def store_objects(objects: DataFrame, path: str) -> None:
    """Objects by hash, dealt over folders by the hash's first two digits. Ranges of hashes make the tasks, so a folder may have many files."""
    rows = objects.dropDuplicates(["object_hash"]).withColumn("prefix", F.substring("object_hash", 1, 2))
    rows.repartitionByRange("object_hash").write.mode("append").partitionBy("prefix").parquet(path)


def stored_objects(objects: DataFrame) -> DataFrame:
    """Stored objects with `intact`: whether the content still has its hash."""
    return objects.withColumn("intact", F.sha2("content", 256) == F.col("object_hash"))
