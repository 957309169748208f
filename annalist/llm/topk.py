"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm import shared

#: Components of the queries in a block, and of the candidates in a shard, at most about so many: 32 MB each as doubles.
BLOCK, SHARD = 4_000_000, 4_000_000
#: Scores of a tile that are held at once.
STRIP = 1_000_000
#: Shards at least, so that a small table is searched in parallel too.
LEAST_SHARDS = 64
#: Lists that one step of the merge tree brings together.
FAN = 16
#: Sums of products below this are exact in double precision.
EXACT = float(2**53)


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def _scores(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors; in whole numbers where doubles could round."""
    most = lambda x: np.abs(x).max(initial=0.0)
    if most(queries) * most(shard) * queries.shape[1] < EXACT:
        return (queries @ shard.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], dtype=object)
    low, high = -(2**63), 2**63 - 1
    return np.array([[min(max(int(v), low), high) for v in row] for row in whole(queries) @ whole(shard).T], dtype=np.int64)


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _tile(queries: pa.Table, shard: pa.Table, k: int) -> pa.Table:
    """The k best candidates of the shard for each query of the block, larger score first, then smaller id. A strip of queries is scored at a time."""
    out = {"key": [], "query_id": [], "vec_id": [], "score": []}
    if queries.num_rows and shard.num_rows:
        width = queries.column("width")[0].as_py()
        q_id, q_key = queries.column("vec_id").to_numpy(), queries.column("key").to_numpy()
        ids = shard.column("c_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, candidates = ids[order], _matrix(shard.column("c_vector"), width)[order]
        asked, rows = _matrix(queries.column("vector"), width), max(1, STRIP // len(ids))
        for first in range(0, len(q_id), rows):
            scores = _scores(asked[first : first + rows], candidates)
            for i, row in enumerate(scores, first):
                at = np.flatnonzero(ids != q_id[i])
                if len(at) > k:
                    least = np.partition(row[at], len(at) - k)[len(at) - k]
                    at = at[row[at] >= least]
                at = at[np.argsort(-row[at].astype(object) if row[at].min(initial=0) == -(2**63) else -row[at], kind="stable")[:k]]
                out["key"].append(np.full(len(at), q_key[i]))
                out["query_id"].append(np.full(len(at), q_id[i]))
                out["vec_id"].append(ids[at])
                out["score"].append(row[at])
    return pa.table({name: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), type=pa.int64()) for name, x in out.items()})


def _best(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int, vector: Column) -> DataFrame:
    """The k vectors with the highest inner product for every query, exactly.

    `vectors` has vec_id; `vector` gives whole-numbered doubles and null for rows that take no
    part. Returns query_id, rank, vec_id, score; ties go to the smaller vec_id.

    Queries are dealt into blocks and candidates into shards by hashes, and each pair of block
    and shard is one matrix product, so memory per task is bounded and no side is broadcast: a block, a shard and a
    strip of scores take some 100 MB. Each query moves once for every shard and each candidate once for every block. A
    tile keeps k per query; lists merge in a tree, `FAN` at a time. Vectors of another
    length than the query's take no part in its list. A query's own row is every row with its
    vec_id; repeated candidate rows are listed each; queries that repeat in full are asked once.
    Null vec_id: no part. A vector is one row; very long ones make blocks of fewer rows. Scores beyond 64 bits stay at the nearest bound. Empty table: no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), is_query.alias("asks"))
    rows = shared.written(rows.where(F.col("vector").isNotNull() & F.col("vec_id").isNotNull()).withColumn("width", F.size("vector")), "topk-vectors")
    n, n_queries = rows.agg(F.coalesce(F.sum("width"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("asks"), F.col("width"))), F.lit(0))).first()
    n_shards, n_blocks = max(LEAST_SHARDS, -(-n // SHARD)), max(1, -(-n_queries // BLOCK))

    key = F.xxhash64("vec_id", "vector")
    queries = rows.where("asks").dropDuplicates(["vec_id", "vector"]).withColumn("key", key)
    queries = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(n_blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    shards = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(2), F.monotonically_increasing_id()), F.lit(n_shards)))
    shards = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    tile = ["block", "shard", "width"]
    left = queries.select(F.col("block").cast("long").alias("block"), F.col("shard").cast("long").alias("shard"), "width", "key", "vec_id", "vector")
    right = shards.select(F.col("block").cast("long").alias("block"), F.col("shard").cast("long").alias("shard"), F.col("width").alias("width"), F.col("vec_id").alias("c_id"), F.col("vector").alias("c_vector"))

    def product(group: tuple, queries: pa.Table, shard: pa.Table) -> pa.Table:
        best = _tile(queries, shard, k)
        return best.append_column("shard", pa.array(np.full(best.num_rows, group[1].as_py()), type=pa.int64()))

    lists = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(product, "key long, query_id long, vec_id long, score long, shard long")
    fan = n_shards
    while fan > FAN:
        fan = -(-fan // FAN)
        lists = _best(lists.withColumn("shard", F.pmod("shard", F.lit(fan))), ["query_id", "key", "shard"], k).drop("rank")
    return _best(lists, ["query_id", "key"], k).select("query_id", "rank", "vec_id", "score")


def op1_tiled_topk(spark, sf_dir):
    """The 20 best of every row for each row whose vec_id is divisible by 20, by inner products of floor(64 x); see `search`.

    Vectors with a component whose 64-fold is no finite double take no part, like those with components that are not finite.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    scaled = lambda x: F.lit(64.0) * x.cast("double")
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < EXACT, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    vector = F.when(usable(F.transform("embedding", scaled)), whole)
    return search(vectors, F.col("vec_id") % 20 == 0, 20, vector)


SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20"""
