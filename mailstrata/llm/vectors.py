"""What the two vector searches share: valid rows, bounded samples and the grid of candidate and query blocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", zero: bool = False, width: int | None = None) -> DataFrame:
    """vec_id long, v array<double> of the rows whose vector is there, not empty and finite in every component (zero: or zero).

    A row without an id takes no part; of several rows with one id the least vector counts. Vectors have width components;
    if that isn't given, the length that most of them have (of two as common, the smaller), and those of another length take no part.
    """
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    if not zero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    if width is None:
        lengths = rows.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), "width").first()
        width = lengths["width"] if lengths else 0
    return rows.where(F.size(vector) == width).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def once(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By id, the least vector of each."""
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    keep = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
    return ids[keep], vectors[keep]


def stacked(column, width: int) -> np.ndarray:
    return np.array([np.asarray(x, dtype=np.float64) for x in column], dtype=np.float64).reshape(-1, width)


def sampled(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n rows with the smallest hashes of their ids, on the driver; n bounds it."""
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n).collect()
    if not found:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    return once(np.array([r["vec_id"] for r in found], np.int64), np.array([r["v"] for r in found], np.float64))


def blocks(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def block_of(n: int, seed: int):
    """A block from 0 to n - 1 by the id's hash."""
    return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")


def spread(rows: DataFrame, own: str, n_own: int, other: str, n_other: int, seed: int) -> DataFrame:
    """rows dealt to n_own blocks of their own, one copy for each of the n_other blocks that they meet."""
    return rows.withColumn(own, block_of(n_own, seed)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
