"""Approximate nearest neighbours with randomly rotated one-bit codes.

Every vector is normalised and rotated by one random rotation (fixed seed); the signs of its
coordinates are its code, packed into bits. Two scalars correct the estimate: the norm and
the inner product of the unit vector with its own code. For a query, the inner product with
a code is summed from bits (the query is held as a few bit planes, so that sums are
popcounts), scaled by the scalars, and comes with an error bound. The vectors with the best
estimates are scored first; every vector whose upper bound reaches the k-th best exact score
so far is then reranked by exact inner products in double precision.

Vectors are dealt into blocks by a hash of their id, so equal or near vectors do not share a
task. Queries are dealt into blocks too; each (vector block, query block) pair is one task
that holds one block of each, and returns at most k rows per query; these are merged per
query. Nothing is collected or broadcast. The codes are made where they are used: they cost
one rotation of the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

SEED = 20240917
PLANES = 6        # bits per query coordinate
EPSILON = 2.5     # standard deviations of the estimate's error (tests measure the recall)
FIRST = 4         # first reranked: FIRST * k vectors with the best estimates
STEP = 64         # queries handled at once
PAIRS = 1 << 15   # exact products taken at once


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    pad = -bits.shape[1] % 64
    wide = np.pad(bits, ((0, 0), (0, pad))).astype(np.uint8)
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


class Codes:
    """One-bit codes of a block of vectors with their correction scalars."""

    def __init__(self, vectors: np.ndarray):
        self.dim = vectors.shape[1]
        self.norm = np.linalg.norm(vectors, axis=1)
        unit = (vectors / self.norm[:, None]) @ rotation(self.dim)
        self.bits = pack(unit > 0)
        self.ones = np.bitwise_count(self.bits).sum(axis=1).astype(np.float64)
        self.own = np.abs(unit).sum(axis=1) / np.sqrt(self.dim)  # <unit, code>, about 0.8

    def estimate(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products with the queries and their error bounds, queries x vectors."""
        q = queries @ rotation(self.dim)
        low = q.min(axis=1, keepdims=True)
        width = np.maximum((q.max(axis=1, keepdims=True) - low) / (2 ** PLANES - 1), 1e-300)
        level = np.rint((q - low) / width).astype(np.int64)
        rounding = np.abs(q - (low + width * level)).sum(axis=1, keepdims=True) / np.sqrt(self.dim)
        hits = np.zeros((len(q), len(self.bits)))  # sum of the levels at the code's ones
        for plane in range(PLANES):
            words = pack((level >> plane) & 1)
            for w in range(words.shape[1]):
                hits += np.bitwise_count(words[:, w, None] & self.bits[None, :, w]) * float(1 << plane)
        at_ones = low * self.ones + width * hits
        with_code = (2 * at_ones - (low * self.dim + width * level.sum(axis=1, keepdims=True))) / np.sqrt(self.dim)
        size = np.linalg.norm(queries, axis=1)[:, None]
        spread = np.sqrt(np.maximum(1 - self.own ** 2, 0) / max(self.dim - 1, 1)) / self.own
        return (with_code * (self.norm / self.own),
                size * (EPSILON * self.norm * spread) + rounding * (self.norm / self.own))


def exact(queries: np.ndarray, vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of query i and vector j of every pair, in double precision."""
    out = np.empty(len(i))
    for b in range(0, len(i), PAIRS):
        out[b:b + PAIRS] = np.einsum("ij,ij->i", queries[i[b:b + PAIRS]], vectors[j[b:b + PAIRS]])
    return out


def block_top(vec_ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
              k: int) -> Iterator[pd.DataFrame]:
    """The k best vectors of a block for each query (equal scores: smaller id)."""
    codes = Codes(vectors)
    for b in range(0, len(queries), STEP):
        q, qid = queries[b:b + STEP], query_ids[b:b + STEP]
        value, error = codes.estimate(q)
        other = qid[:, None] != vec_ids[None, :]
        bound = np.full(len(q), -np.inf)
        if value.shape[1] > FIRST * k:
            first = np.argpartition(np.where(other, value, -np.inf), -FIRST * k, axis=1)[:, -FIRST * k:]
            scores = np.einsum("ij,ikj->ik", q, vectors[first])
            scores[vec_ids[first] == qid[:, None]] = -np.inf
            bound = np.partition(scores, -k, axis=1)[:, -k]
        i, j = np.nonzero(other & (value + error >= bound[:, None]))
        score = exact(q, vectors, i, j)
        order = np.lexsort((vec_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < k
        yield pd.DataFrame({"query_id": qid[i[top]], "vec_id": vec_ids[j[top]], "score": score[top]})


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, block_rows: int = 16384,
            key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows by inner product of each row whose ``key`` is divisible by
    ``every``: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Defined cases: NULL ids, and vectors that are NULL, empty, zero or hold NULL or non-finite
    components, take no part; vectors are compared with those of the same length only; fewer
    candidates than ``k`` are all returned; equal scores go to the smaller id; rows with one id
    count once (one of them, by the order of their components); an empty table gives an empty
    result; other columns are not read.
    """
    spark = vectors.sparkSession
    good = (F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull())
    rows = (vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
            .where(good).groupBy("id").agg(F.min("v").alias("v")))
    rows = rows.withColumn("dim", F.size("v"))
    counts = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("id") % every == 0, 1))).first()
    blocks, q_blocks = -(-counts[0] // block_rows) or 1, -(-counts[1] // block_rows) or 1
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    # each block of vectors meets each block of queries: the stated query set, in blocks
    data = (rows.withColumn("b", deal(blocks, 1))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    asked = (rows.where(F.col("id") % every == 0).withColumn("qb", deal(q_blocks, 2))
             .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                               "score": pd.Series(dtype="float64")})]
        if len(left) and len(right):
            parts += block_top(left["id"].to_numpy(), np.stack(left["v"].to_numpy()),
                               right["id"].to_numpy(), np.stack(right["v"].to_numpy()), k)
        return pd.concat(parts, ignore_index=True)

    by = ["b", "qb", "dim"]
    top = (data.groupBy(*by).cogroup(asked.groupBy(*by))
           .applyInPandas(search, "query_id long, vec_id long, score double"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (top.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
