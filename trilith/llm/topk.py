"""Operator 1, exact top-k search: a grid of query blocks by vector shards, one matrix product for each cell.

Queries and vectors are dealt out by hash to blocks and shards of bounded size; every cell of the grid keeps its best k
of each query, and the lists merge in a tree. The query set is stated, and all pairs of a query and a vector are
scored: no pair row is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions_for, read

QUERY_BLOCK, SHARD = 2048, 8192
#: Lists of a query that one merge takes.
FAN_IN = 16


def finite(c: Column) -> Column:
    """Whether a vector takes part: neither null nor with a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return c.isNotNull() & ~F.exists(c, bad)


def grid(queries: DataFrame, vectors: DataFrame, query_block: int = QUERY_BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame, int]:
    """Rows of queries(vec_id, ...) and vectors(vec_id, ...) with the cells (dim, block, shard) they belong to, and the number of shards."""
    n_blocks, n_shards = partitions_for(queries.count(), query_block, 1), partitions_for(vectors.count(), shard, 8)
    # a cogroup of two frames of one origin mixes up their columns unless these have identities of their own
    queries = queries.select(*(F.col(c).alias(c) for c in queries.columns))
    salt = lambda s: F.xxhash64("vec_id", F.lit(s))
    q = queries.withColumn("block", F.pmod(salt(1), F.lit(n_blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    v = vectors.withColumn("shard", F.pmod(salt(2), F.lit(n_shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return q, v, n_shards


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of one query's k best, the highest score first and ties to the smaller id."""
    if len(scores) > 4 * k:
        # all that tie with the k-th stay in
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((-ids[some], scores[some]))[::-1][:k]]


def merged(lists: DataFrame, k: int, n_shards: int) -> DataFrame:
    """lists(query_id, shard, vec_id, score) -> query_id, rank, vec_id, score: each query's k best, merged in a tree."""
    order = [F.desc("score"), F.asc("vec_id")]
    while n_shards > FAN_IN:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
        n_shards = -(-n_shards // FAN_IN)
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles where sums stay under 2**53, else in Python's integers."""
    most = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1]
    if most < 2**53:
        return q @ v.T
    whole = lambda a: np.array([[int(x) for x in row] for row in a], dtype=object)
    a, b = whole(q), whole(v)
    total = reduce(lambda s, j: s + np.multiply.outer(a[:, j], b[:, j]), range(q.shape[1]), np.zeros((len(q), len(v)), dtype=object))
    return np.clip(total, -(2**63), 2**63 - 1).astype(np.int64)


def _cell(k: int):
    def run(key: tuple, q: pd.DataFrame, v: pd.DataFrame) -> Iterator[pd.DataFrame] | pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "shard": np.zeros(0, np.int32), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if not len(q) or not len(v):
            return empty
        ids, qids, out = v.vec_id.to_numpy(), q.vec_id.to_numpy(), []
        a, b = stacked(q.whole), stacked(v.whole)
        for at in range(0, len(q), 256):
            scores = _exact_products(a[at : at + 256], b)
            for i, row in enumerate(scores):
                own = ids != qids[at + i]
                some = np.flatnonzero(own) if not own.all() else None
                s, d = (row, ids) if some is None else (row[some], ids[some])
                top = best(s, d, k)
                out.append((np.full(len(top), qids[at + i]), d[top], s[top].astype(np.int64)))
        if not out:
            return empty
        query, vec, score = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"query_id": query, "shard": np.int32(key[2]), "vec_id": vec, "score": score})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, query_block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """vectors(vec_id, embedding, ...), queries (rows of the same kind) -> query_id, rank, vec_id, score.

    Components count as floor(scale * x); the score is their inner product, exact (past the range of a long it stops at
    its ends). A query's own vec_id is no candidate; ties go to the smaller vec_id; with fewer candidates all return.
    Vectors that are null or hold a null or non-finite component, and null ids, take no part; vectors of different
    lengths don't meet; empty vectors score 0 with one another; rows that repeat a vec_id are candidates each; other
    columns are ignored; an empty table gives an empty result.
    """
    whole = lambda df: df.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("whole"), F.size("embedding").alias("dim"))
    q, v, n_shards = grid(whole(queries), whole(vectors), query_block, shard)
    lists = q.groupBy("dim", "block", "shard").cogroup(v.groupBy("dim", "block", "shard")).applyInPandas(_cell(k), "query_id long, shard int, vec_id long, score long")
    return merged(lists, k, n_shards)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE_SQL = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
