"""Operator 2, approximate nearest neighbours by randomly rotated one-bit codes.

A vector's direction is rotated by a random orthogonal matrix (after padding with zeros) and only the signs are kept,
packed eight to a byte, with two correction scalars: the norm, and the inner product of the code with the direction.
With them the inner product with a query is estimated without bias, and its error is bounded with high probability.
Only vectors whose bound reaches the k-th lower bound are scored on the original components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, read
from .topk import best, finite, grid, merged, stacked

#: Bits a component: the vector is padded to this many times its length before it is rotated.
BITS = 4
#: Width of the error bound in standard deviations of the estimate.
EPSILON = 2.5
SEED = 20240517
QUERY_BLOCK, SHARD = 2048, 8192

_rotations: dict[tuple[int, int, int], np.ndarray] = {}


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """The first dim rows of a random orthogonal matrix of width dim * bits, the same in every process."""
    if (dim, bits, seed) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim * bits, dim * bits)))
        _rotations[dim, bits, seed] = np.ascontiguousarray((q * np.sign(np.diag(r)))[:dim]).astype(np.float32)
    return _rotations[dim, bits, seed]


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length 1, their lengths), whatever the size of finite components."""
    top = np.abs(vectors).max(axis=1, initial=0)
    top[top == 0] = 1
    small = vectors / top[:, None]
    size = np.sqrt((small * small).sum(axis=1))
    return small / np.maximum(size, 1e-300)[:, None], size * top


def encode(vectors: np.ndarray, bits: int = BITS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, norms, inner product of each code with its direction)."""
    unit, norms = directions(vectors)
    turned = unit.astype(np.float32) @ rotation(vectors.shape[1], bits, seed)
    align = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(turned > 0, axis=1), norms, align


def estimates(queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, align: np.ndarray, bits: int = BITS, seed: int = SEED, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products of the directions of queries with coded vectors, bounds of their errors by vector).

    Only directions are multiplied in single precision; norms come in afterwards, in double.
    """
    width = queries.shape[1] * bits
    signs = np.unpackbits(codes, axis=1, count=width).astype(np.float32) * 2 - 1
    turned = directions(queries)[0].astype(np.float32) @ rotation(queries.shape[1], bits, seed)
    about = (turned @ (signs * (1 / (align * np.sqrt(width))).astype(np.float32)[:, None]).T) * norms
    return about, epsilon * norms * np.sqrt(np.maximum(0, 1 - align**2)) / align / np.sqrt(max(1, width - 1))


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of one query, component after component, so that equal vectors score alike everywhere."""
    total = np.zeros(len(v))
    for j in range(v.shape[1]):
        total += q[j] * v[:, j]
    return total


def _coded(bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lists = part.column("embedding")
                values, dims = np.asarray(lists.flatten(), np.float64), np.asarray(lists.value_lengths())
                first = np.cumsum(dims) - dims
                code, norm, align = np.empty(len(dims), object), np.ones(len(dims)), np.ones(len(dims))
                for dim in np.unique(dims):
                    some = np.flatnonzero(dims == dim)
                    c, norm[some], align[some] = encode(values[first[some][:, None] + np.arange(dim)], bits, seed)
                    code[some] = [x.tobytes() for x in c]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(code, pa.binary()), pa.array(norm), pa.array(align)], names=[*part.schema.names, "code", "norm", "align"])

    return run


def index(vectors: DataFrame, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, embedding, dim, code, norm, align: one row for each vector that takes part, encoded once."""
    used = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    # single precision stays: it is half the size and the same numbers
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    used = used.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), F.size("embedding").alias("dim"))
    return checkpointed(used.mapInArrow(_coded(bits, seed), f"vec_id long, embedding array<{kind}>, dim int, code binary, norm double, align double"))


def _cell(k: int, bits: int, seed: int, epsilon: float):
    def run(key: tuple, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            ids, qids, a, b = v.vec_id.to_numpy(), q.vec_id.to_numpy(), stacked(q.embedding), stacked(v.embedding)
            codes = np.frombuffer(b"".join(v.code), np.uint8).reshape(len(v), -1)
            norm, align = v.norm.to_numpy(), v["align"].to_numpy()
            for at in range(0, len(q), 256):
                about, error = estimates(a[at : at + 256], codes, norm, align, bits, seed, epsilon)
                for i in range(len(about)):
                    low, high = about[i] - error, about[i] + error
                    low[ids == qids[at + i]] = -np.inf
                    floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
                    some = np.flatnonzero((high >= floor) & (ids != qids[at + i]))
                    score = exact(a[at + i], b[some])
                    top = best(score, ids[some], k)
                    out.append((np.full(len(top), qids[at + i]), ids[some][top], score[top]))
        query, vec, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"query_id": query, "shard": np.full(len(query), key[2], np.int32), "vec_id": vec, "score": score})

    return run


def nearest(indexed: DataFrame, queries: DataFrame, k: int = 20, bits: int = BITS, seed: int = SEED, epsilon: float = EPSILON, query_block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """indexed: of index(); queries: rows of index() -> query_id, rank, vec_id, score (the inner product of the originals).

    A query's own vec_id is no candidate; ties go to the smaller vec_id; with fewer candidates all return. Vectors that
    are null, zero, or hold a null or non-finite component, and null ids, take no part; vectors of different lengths
    don't meet; rows that repeat a vec_id are candidates each; other columns are ignored; an empty table gives an empty
    result. epsilon widens the error bound: more vectors are scored exactly and fewer missed.
    """
    q, v, n_shards = grid(queries.select("vec_id", "embedding", "dim"), indexed, query_block, shard)
    lists = q.groupBy("dim", "block", "shard").cogroup(v.groupBy("dim", "block", "shard")).applyInPandas(_cell(k, bits, seed, epsilon), "query_id long, shard int, vec_id long, score double")
    return merged(lists, k, n_shards)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = index(read(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


#: Exact search; what the bounds choose contains it at the sizes that SQL is run on.
ORACLE_SQL = {
    "op2_ann": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.w, c.w) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
