"""Isolation forest: a comparator beside the rarity table. Trees grow on the driver from a bounded hash sample; all rows are scored where they lie."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trees, rows of a tree, and rows that trees draw from: the ones with the smallest hashes, so a rerun draws alike.
TREES, SAMPLE, POOL = 200, 256, 8192


def mean_path(n: int) -> float:
    """Mean length of an unsuccessful search among n rows: what a leaf of n rows would still need, and what scores are measured by."""
    if n < 2:
        return 0.0
    return 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else 1.0


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees in one row of arrays: feature (-1: a leaf), threshold, left, right, length (of a leaf: its depth and what its rows would still need)."""

    features: tuple[str, ...]
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    sample: int

    def lengths(self, x: np.ndarray) -> np.ndarray:
        """The mean path length of every row of x."""
        total, every = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                lower = x[every, np.maximum(self.feature[at], 0)] < self.threshold[at]
                at = np.where(inner, np.where(lower, self.left[at], self.right[at]), at)
            total += self.length[at]
        return total / len(self.roots)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher is odder; one half where rows are as deep as on average."""
        return 2.0 ** (-self.lengths(x) / max(mean_path(self.sample), 1e-12)) if len(self.roots) else np.zeros(len(x))


def grow(x: np.ndarray, features: list[str], seed: int, trees: int = TREES, sample: int = SAMPLE) -> Forest:
    """A forest over the rows of x; every tree draws sample of them without replacement. Missing values must be filled."""
    random = np.random.RandomState(seed)
    size = min(sample, len(x))
    deepest = math.ceil(math.log2(size)) if size > 1 else 0
    nodes: list[list[float]] = []
    roots = []

    def node(rows: np.ndarray, depth: int) -> int:
        k = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + mean_path(len(rows))])
        low, high = rows.min(0), rows.max(0)
        uneven = np.flatnonzero(high > low)
        if depth < deepest and len(rows) > 1 and len(uneven):
            f = int(random.choice(uneven))
            cut = random.uniform(low[f], high[f])
            lower = rows[:, f] < cut
            if lower.any() and not lower.all():
                nodes[k][:2] = [f, cut]
                nodes[k][2] = node(rows[lower], depth + 1)
                nodes[k][3] = node(rows[~lower], depth + 1)
        return k

    if size:
        roots = [node(x[random.choice(len(x), size, replace=False)], 0) for _ in range(trees)]
    a = np.array(nodes, np.float64).reshape(-1, 5)
    whole = lambda i: a[:, i].astype(np.int64)
    return Forest(tuple(features), np.array(roots, np.int64), whole(0), a[:, 1], whole(2), whole(3), a[:, 4], size)


def fit(reference: DataFrame, id_: list[str], features: list[str], seed: int, trees: int = TREES, sample: int = SAMPLE, pool: int = POOL) -> Forest:
    """A forest over reference; missing values count as -1. pool bounds the rows that reach the driver; an empty reference gives a forest without trees, whose scores are 0."""
    values = [F.coalesce(F.col(f).cast("double"), F.lit(-1.0)).alias(f) for f in features]
    rows = reference.select(F.xxhash64(*id_, F.lit(seed)).alias("_h"), *values).orderBy("_h", *features).limit(pool).toPandas()
    return grow(rows[features].to_numpy(np.float64), features, seed, trees, sample)


def score(forest: Forest) -> Column:
    """The score of a row; the forest, a few MB at most by its number of nodes, goes to the tasks with the function."""

    @F.pandas_udf("double")
    def scored(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.scores(np.stack([c.to_numpy(np.float64) for c in columns], 1)))

    return scored(*[F.coalesce(F.col(f).cast("double"), F.lit(-1.0)) for f in forest.features])


NODES = "tree_root boolean, node long, feature long, threshold double, left long, right long, length double, sample long, features array<string>"


def as_table(spark, forest: Forest) -> DataFrame:
    """A row for each node, so that a forest is stored and read like any other table."""
    roots = set(forest.roots.tolist())
    rows = [(i in roots, i, int(f), float(t), int(a), int(b), float(n), forest.sample, list(forest.features)) for i, (f, t, a, b, n) in enumerate(zip(forest.feature, forest.threshold, forest.left, forest.right, forest.length, strict=True))]
    return spark.createDataFrame(rows, NODES)


def from_table(nodes: DataFrame) -> Forest:
    x = nodes.orderBy("node").toPandas()
    features = tuple(x["features"].iloc[0]) if len(x) else ()
    column = lambda c, kind: x[c].to_numpy(kind)
    return Forest(features, np.flatnonzero(x["tree_root"].to_numpy(bool)), column("feature", np.int64), column("threshold", np.float64), column("left", np.int64), column("right", np.int64), column("length", np.float64), int(x["sample"].iloc[0]) if len(x) else 0)
