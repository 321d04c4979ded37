"""Exact top-k by inner product: a KD-tree per shard, searched best first.

Candidates are dealt to shards of about SHARD rows by their ids' hashes, so neither
copies nor clusters make a shard larger. Each shard's tree splits at medians of the widest
component and keeps tight boxes. A query opens boxes by their upper bound, sum of
max(q*low, q*high), until no box can hold anything above its kth score. Shards are searched in waves, each
GROWTH times as large as all before it together, and the kth score found so far goes with the query into the next wave, so later shards prune from
the first box on and return only what may belong to the whole result. The first wave starts from a bounded sample of all candidates.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, saved
from .vectors import block_of, blocks, once, sampled, stacked, usable

#: Rows of a shard, rows of a leaf, queries of a block, rows of the sample that gives the first bounds, growth of the waves.
SHARD, LEAF, QUERIES, SAMPLE, GROWTH = 8192, 128, 16_384, 2048, 3


class KDTree:
    """points: rows by id. Nodes: low, high, left, right (-1 in a leaf), first and end row in order."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        low, high, left, right, first, end = [], [], [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            k = len(low)
            if parent >= 0:
                (left if side == 0 else right)[parent] = k
            inside = points[self.order[a:b]]
            low.append(inside.min(0))
            high.append(inside.max(0))
            left.append(-1)
            right.append(-1)
            first.append(a)
            end.append(b)
            width = high[-1] - low[-1]
            if b - a > leaf and width.max() > 0:
                d, middle = int(width.argmax()), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(inside[:, d], middle, kind="introselect")]
                todo += [(a, a + middle, k, 0), (a + middle, b, k, 1)]
        self.low, self.high = np.array(low), np.array(high)
        self.left, self.right, self.first, self.end = left, right, first, end

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each query can have in each box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: KDTree, ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int):
    """(query row, candidate row, score) of the k best of each query with at least its kth score so far; ties to smaller ids."""
    out = []
    bounds = tree.bounds(queries)
    for i, q in enumerate(queries):
        best: list[tuple[float, int, int]] = []  # the worst first: score, -id, row
        least = kth[i]
        heap = [(-bounds[i, 0], 0)]
        while heap and -heap[0][0] >= least:
            _, node = heapq.heappop(heap)
            if tree.left[node] >= 0:
                for child in (tree.left[node], tree.right[node]):
                    if bounds[i, child] >= least:
                        heapq.heappush(heap, (-bounds[i, child], child))
                continue
            rows = tree.order[tree.first[node] : tree.end[node]]
            scores = points[rows] @ q
            keep = (scores >= least) & (ids[rows] != query_ids[i])
            rows, scores = rows[keep], scores[keep]
            if len(rows) > k:
                top = np.lexsort((ids[rows], -scores))[:k]
                rows, scores = rows[top], scores[top]
            for r, s in zip(rows.tolist(), scores.tolist(), strict=True):
                item = (s, -int(ids[r]), r)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                least = max(least, best[0][0])
        out += [(i, r, s) for s, _, r in best]
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of rows with the largest inner product, ties to smaller ids.

    rows and queries: vec_id long, v array<double> of whole numbers and one length. Sums are exact
    while they stay under 2**53. A query's own id is no candidate; ids that repeat count once;
    without queries or candidates there are no rows.
    """
    n, n_queries = rows.count(), queries.count()
    sample_ids, sample = sampled(rows, SAMPLE)
    shards, parts, width = blocks(n, SHARD), blocks(n_queries, QUERIES), sample.shape[1]

    def joined(key: tuple, cand: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if not len(cand) or not len(query):
            return none
        ids, points = once(cand["vec_id"].to_numpy(np.int64), stacked(cand["v"], width))
        query_ids, q = once(query["vec_id"].to_numpy(np.int64), stacked(query["v"], width))
        so_far = dict(zip(query["vec_id"], query["kth"].astype(float).fillna(-np.inf), strict=True))
        kth = np.array([so_far[i] for i in query_ids])
        scores = np.where(sample_ids[None] == query_ids[:, None], -np.inf, q @ sample.T)
        if scores.shape[1] > k:
            kth = np.maximum(kth, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
        found = search(KDTree(points), ids, points, query_ids, q, kth, k)
        if not found:
            return none
        a, b, s = (np.array(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"query_id": query_ids[a], "vec_id": ids[b], "score": s.astype(np.int64)})

    placed = rows.withColumn("_shard", block_of(shards, 1))
    asked = saved(queries.withColumn("_part", block_of(parts, 2)), "topk-queries")
    best, first = None, 0
    while first < shards:
        last = min(shards, first + max(1, GROWTH * first))
        bounded = asked.withColumn("kth", F.lit(None).cast("long"))
        if best is not None:
            kth = best.groupBy(F.col("query_id").alias("_asked")).agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
            bounded = asked.join(kth, F.col("vec_id") == F.col("_asked"), "left").drop("_asked")
        left = placed.where(F.col("_shard").between(first, last - 1)).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        right = bounded.withColumn("_shard", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        found = left.groupBy("_shard", "_part").cogroup(right.groupBy("_shard", "_part")).applyInPandas(joined, "query_id long, vec_id long, score long")
        if best is not None:
            found = found.unionByName(best.select("query_id", "vec_id", "score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        before, best = best, saved(ranked.select("query_id", "rank", "vec_id", "score"), "topk-wave")
        dropped(before)
        first = last
    return best


def op8_exact_topk(spark, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), zero=True)
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * 256).cast("double")).alias("v"))
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


ORACLE = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
