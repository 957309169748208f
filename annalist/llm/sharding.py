"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import shared

ROUNDS = 6


class Feistel:
    """A seeded permutation of 0..n-1, computable in both directions.

    The network permutes the next even power of two; values that leave the range walk on
    along their cycle until they are back inside.
    """

    def __init__(self, n: int, seed: int):
        self.n, self.seed = n, seed
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)

    def _mixed(self, x: np.ndarray, turn: int) -> np.ndarray:
        key = (self.seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & (2**64 - 1)
        with np.errstate(over="ignore"):
            x = x.astype(np.uint64) + np.uint64(key)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, turns) -> np.ndarray:
        low = np.uint64((1 << self.half) - 1)
        left, right = x >> np.uint64(self.half), x & low
        for turn in turns:
            left, right = right, left ^ self._mixed(right, turn)
        return (right << np.uint64(self.half)) | left  # halves swapped, so the inverse is the same walk

    def _walk(self, values, turns) -> np.ndarray:
        x = np.array(values, dtype=np.uint64)
        out = np.ones(len(x), dtype=bool)
        while out.any():
            x[out] = self._once(x[out], turns)
            out = x >= self.n
        return x.astype(np.int64)

    def forward(self, values) -> np.ndarray:
        return self._walk(values, range(ROUNDS))

    def backward(self, values) -> np.ndarray:
        return self._walk(values, range(ROUNDS)[::-1])


def locate(row_number: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a row, without the data."""
    p = int(Feistel(n, seed).forward([row_number])[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that stands at a shard and slot."""
    return int(Feistel(n, seed).backward([slot * shards + shard])[0])


def assign(rows: DataFrame, order: list, shards: int, seed: int = 7) -> DataFrame:
    """Adds row_number, shard and slot; the row's place in `order` decides.

    Counts of shards differ by one at most, and slots run from 0 without gaps. Rows that are
    equal in `order` are interchangeable, so repeated rows each have a place. Nulls stand where `order` puts them. An empty
    table stays empty. Columns named row_number, shard or slot are replaced, others stay. Rows are shuffled whole, once, by ranges
    of the order: to shard very long texts, assign their keys and join.
    """
    rows, n = shared.numbered(rows.drop("shard", "slot"), order, "shard-rows")
    permutation = Feistel(n, seed)

    @F.pandas_udf("long")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(permutation.forward(values.to_numpy()))

    placed = rows.withColumn("__place", place("row_number"))
    return placed.withColumn("shard", F.pmod("__place", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"__place div {shards}")).drop("__place")


def write_shards(rows: DataFrame, path: str) -> None:
    """Writes assigned rows by shard, each in slot order.

    All columns are written, null or not; repeated rows have slots of their own. An empty table writes no shard. A path that is there is refused. A shard is sorted in one task, which spills to disk.
    """
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_feistel_sharding(spark, sf_dir):
    """Law `rows`: row numbers in order of (doc_id, size, checksum), nulls first.

    Null text: size 8 and the checksum of nothing, 0. A text of any length counts by its size and checksum only.
    """
    size = F.octet_length(shared.text_or_empty()).cast("long") + 8
    rows = shared.documents(spark, sf_dir).select("doc_id", size.alias("size"), F.crc32(shared.text_or_empty()).alias("text_crc32"))
    placed = assign(rows, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
