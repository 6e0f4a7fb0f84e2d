"""Exact nearest vectors of a query set, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512
ROWS = 20_000


def unit_rows(vectors: list[list[float]], dim: int) -> np.ndarray:
    """Rows of length one, padded to dim; scaled by the largest component first, so squares neither overflow nor vanish."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True, initial=1e-300)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < F.lit(float("inf")))) & F.exists(vector, lambda c: c != 0)
    return df.where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False))).select(key, vector)


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, cosine, rank): the k vectors closest to each query but itself; ties go to the smaller key.

    Tiles of ROWS vectors by BLOCK queries are multiplied one at a time; each tile gives at most k rows a query. Vectors that are null,
    empty, zero or hold null or non-finite components take no part, nor do null keys; shorter vectors than the longest are padded
    with zeros. Rows that repeat a key are neighbours of others each for itself, but never of their own key.
    """
    vectors, queries = (_usable(df, key, vector) for df in (vectors, queries))
    sizes = vectors.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dim")).first()
    asked_for = queries.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dim")).first()
    n, q, dim = sizes.n, asked_for.n, max(sizes.dim or 1, asked_for.dim or 1)
    tiles, blocks = max(1, -(-n // ROWS)), max(1, -(-q // BLOCK))
    a = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"), F.pmod(F.xxhash64(key), F.lit(tiles)).alias("a"))
    b = queries.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("b"))
    left = a.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = b.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))

    def tile(x: pa.Table, y: pa.Table) -> pa.Table:
        names, asked = x.column("id").to_numpy(), y.column("id").to_numpy()
        out = [[], [], []]
        if len(names) and len(asked):
            u, v = (unit_rows(t.column("x").to_pylist(), dim) for t in (x, y))
            for i, row in enumerate(v @ u.T):
                row[names == asked[i]] = -np.inf
                best = np.flatnonzero(row >= -np.partition(-row, k - 1)[k - 1]) if len(row) > k else np.arange(len(row))
                best = best[row[best] > -np.inf]
                best = best[np.lexsort((names[best], -row[best]))][:k]
                for column, value in zip(out, (np.full(len(best), asked[i]), names[best], row[best])):
                    column.extend(value.tolist())
        return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query", key, "cosine"])

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(tile, f"query long, {key} long, cosine double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), key))).where(F.col("rank") <= k)
