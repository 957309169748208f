"""What the corpus operators share: word pattern, shared folder, written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a local master, a folder of our own where none is set. A cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="annalist-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def _removed(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """`df` written to the shared folder and read again: cuts lineage and outlives lost executors.

    The files of `instead_of`, written before and no longer read, are deleted behind it; all others when the application ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if instead_of is not None:
        _removed(spark, instead_of.scratch_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def numbered(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """Adds `row_number` 0..n-1 in `order`, and returns n. A column of that name is replaced.

    Rows are dealt by ranges of the order, so no task holds more than its range; only one
    count per partition comes to the driver.
    """
    spark = df.sparkSession
    dealt = df.drop("row_number").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    rows = written(dealt.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    counts = sorted((r["p"], r["count"]) for r in rows.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    small = spark.createDataFrame(offsets or [(0, 0)], "__part long, __offset long")
    rows = rows.withColumn("__part", part).join(F.broadcast(small), "__part")
    return rows.withColumn("row_number", F.col("__offset") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__offset"), total
