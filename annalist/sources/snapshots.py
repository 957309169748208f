"""Snapshots of several tables: files first, then one manifest that fixes what there is; readers take that and refuse anything else."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMAT = 1
MANIFEST = "manifest"
#: Rows of a file at most, so that none grows beyond what a task can hash (a file has to stay below 2 GB).
ROWS_PER_FILE = 5_000_000


class Refused(ValueError):
    """A snapshot that is not there, not whole, or not what its manifest says."""


def _files(spark: SparkSession, path: str, hashed: bool) -> DataFrame:
    """table, file, bytes and, if asked, sha256 of the data files below a snapshot's tables."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/tables")
    parts = F.split(F.substring_index("path", "/tables/", -1), "/")
    digest: Column = F.sha2("content", 256) if hashed else F.lit(None).cast("string")
    return found.select(parts[0].alias("table"), F.array_join(F.slice(parts, 2, 99), "/").alias("file"), F.col("length").alias("bytes"), digest.alias("sha256")).where(~F.col("file").startswith("_"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def publish(tables: dict[str, DataFrame], path: str, snapshot_at: datetime.datetime) -> None:
    """Writes the tables below a new path, then the manifest: it is written aside and renamed, so it is there as a whole or not at all.

    The tables should be reads of inputs that do not change meanwhile. A path that has a manifest is refused; what an attempt that failed has left is written over.
    """
    spark = next(iter(tables.values())).sparkSession
    if _exists(spark, f"{path}/{MANIFEST}"):
        raise Refused("there is a snapshot already")
    for name, df in tables.items():
        df.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{path}/tables/{name}")
    schemas = F.create_map(*[F.lit(x) for name, df in tables.items() for x in (name, df.schema.json())])
    rows = _files(spark, path, True).withColumns({"format": F.lit(FORMAT), "snapshot_at": F.lit(snapshot_at), "schema": schemas[F.col("table")]})
    rows.write.mode("overwrite").parquet(f"{path}/{MANIFEST}.written")
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.rename(Path(f"{path}/{MANIFEST}.written"), Path(f"{path}/{MANIFEST}")):
        raise Refused("the manifest could not be put in place")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """table, file, bytes, sha256, format, snapshot_at and schema of a snapshot."""
    if not _exists(spark, f"{path}/{MANIFEST}/_SUCCESS"):
        raise Refused("there is no manifest")
    return spark.read.parquet(f"{path}/{MANIFEST}")


def differences(spark: SparkSession, path: str, hashed: bool = True) -> DataFrame:
    """table, file and what is wrong with it: `missing`, `unknown` or `changed`. Without hashes only sizes are compared, and no file is read."""
    told, there = manifest(spark, path).alias("m"), _files(spark, path, hashed).alias("f")
    both = told.join(there, (F.col("m.table") == F.col("f.table")) & (F.col("m.file") == F.col("f.file")), "full")
    other = (F.col("m.bytes") != F.col("f.bytes")) | ((F.col("m.sha256") != F.col("f.sha256")) if hashed else F.lit(False))
    wrong = F.when(F.col("f.file").isNull(), "missing").when(F.col("m.file").isNull(), "unknown").when(other, "changed")
    return both.select(F.coalesce("m.table", "f.table").alias("table"), F.coalesce("m.file", "f.file").alias("file"), wrong.alias("wrong")).where("wrong IS NOT NULL")


def read(spark: SparkSession, path: str, hashed: bool = True) -> dict[str, DataFrame]:
    """The tables of a snapshot by name; refused if the format is another or any file is missing, changed or unknown."""
    heads = manifest(spark, path).groupBy("table").agg(F.first("schema").alias("schema"), F.min("format").alias("least"), F.max("format").alias("most")).collect()  # a row a table
    if not heads or any((h["least"], h["most"]) != (FORMAT, FORMAT) for h in heads):
        raise Refused("another format")
    if wrong := differences(spark, path, hashed).limit(1).collect():
        raise Refused(f"{wrong[0]['wrong']}: {wrong[0]['table']}/{wrong[0]['file']}")
    return {h["table"]: spark.read.schema(StructType.fromJson(json.loads(h["schema"]))).parquet(f"{path}/tables/{h['table']}") for h in heads}
