"""Approximate nearest neighbours: anisotropic four-bit product quantisation, table scans, exact reranking.

Nearest by Euclidean distance is largest q.x - |x|^2/2, a maximum inner product with an
exact last term. Vectors are cut into subspaces of two components, each coded by one of 16
centres. Codes and centres minimise a score-aware loss: the part of the residual parallel
to the vector, which shifts its large inner products, costs ETA times the part across it.
A scan adds up, for each query, entries of a table of 256 sums per pair of codes; the best
SHORTLIST rows of each query are then scored on the original vectors.

Rows with one vector are one class: its smallest id is coded, scanned and scored for all, so copies fill no
shortlist, and the nearest classes' members are joined back, as many of each as a result can hold.

Centres are fitted on TRAIN distinct vectors; every one is coded and scanned. Ids' hashes deal codes and
queries to blocks, so no key and no cluster makes a task larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small
from .vectors import blocks, sampled, spread, stacked, usable

#: Rows that centres are fitted on, rounds of fitting, cosine from which scores matter, candidates reranked for a query, codes and queries of a block.
TRAIN, ROUNDS, COSINE, SHORTLIST, CODES, QUERIES = 8192, 8, 0.3, 600, 262_144, 4096
#: Queries whose tables are held at once.
TABLES = 128


class Quantiser:
    def __init__(self, sample: np.ndarray, seed: int = 7):
        self.width = sample.shape[1]
        self.parts = -(-self.width // 4) * 2  # an even number of subspaces of two components
        # weight of the parallel residual against the rest, for scores from COSINE on
        self.eta = max(1.0, (self.width - 1) * COSINE**2 / (1 - COSINE**2))
        rng = np.random.RandomState(seed)
        x = self._cut(sample)
        pick = rng.choice(len(x), 16, replace=len(x) < 16)
        self.centres = np.ascontiguousarray(x[pick].transpose(1, 0, 2))  # part, centre, component
        for _ in range(ROUNDS):  # plain k-means first
            codes = self._nearest(x)
            for m in range(self.parts):
                for c in range(16):
                    own = codes[:, m] == c
                    if own.any():
                        self.centres[m, c] = x[own, m].mean(0)
        u = self._directions(x)
        for _ in range(ROUNDS // 2):
            self._refit(x, u, self._codes(x, u))

    def _cut(self, v: np.ndarray) -> np.ndarray:
        return np.pad(v, ((0, 0), (0, self.parts * 2 - self.width))).reshape(len(v), self.parts, 2)

    def _directions(self, x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x**2).sum((1, 2), keepdims=True))
        return x / np.where(norm > 0, norm, 1)

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        return np.stack([((x[:, m, None] - self.centres[m][None]) ** 2).sum(-1).argmin(1) for m in range(self.parts)], 1)

    def _codes(self, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Codes by coordinate descent on the score-aware loss, from the nearest centres."""
        codes = self._nearest(x)
        rows = np.arange(len(x))
        parallel = np.zeros(len(x))  # of the whole residual along the vector
        for m in range(self.parts):
            parallel += ((x[:, m] - self.centres[m][codes[:, m]]) * u[:, m]).sum(1)
        for _ in range(2):
            for m in range(self.parts):
                rest = x[:, m, None] - self.centres[m][None]
                along = (rest * u[:, m, None]).sum(-1)
                others = parallel - along[rows, codes[:, m]]
                codes[:, m] = ((rest**2).sum(-1) + (self.eta - 1) * (others[:, None] + along) ** 2).argmin(1)
                parallel = others + along[rows, codes[:, m]]
        return codes

    def _refit(self, x: np.ndarray, u: np.ndarray, codes: np.ndarray) -> None:
        """Each centre to the minimum of the loss over its rows: a system of two equations."""
        own = lambda m: x[:, m] - self.centres[m][codes[:, m]]
        parallel = sum((own(m) * u[:, m]).sum(1) for m in range(self.parts))
        for m in range(self.parts):
            others = parallel - (own(m) * u[:, m]).sum(1)
            for c in range(16):
                at = codes[:, m] == c
                if at.any():
                    um, xm = u[at, m], x[at, m]
                    a = at.sum() * np.eye(2) + (self.eta - 1) * um.T @ um
                    b = xm.sum(0) + (self.eta - 1) * (um * (others[at] + (um * xm).sum(1))[:, None]).sum(0)
                    self.centres[m, c] = np.linalg.solve(a, b)
            parallel = others + (own(m) * u[:, m]).sum(1)

    def encode(self, v: np.ndarray) -> np.ndarray:
        """Two codes to a byte."""
        x = self._cut(v)
        codes = self._codes(x, self._directions(x)).astype(np.uint8)
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def tables(self, q: np.ndarray) -> np.ndarray:
        """query, byte, 256: the inner product that each byte of codes adds."""
        t = np.einsum("qmd,mcd->qmc", self._cut(q), self.centres)
        low, high = t[:, 0::2], t[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), self.parts // 2, 256).astype(np.float32)


def shortlist(scores: np.ndarray, n: int) -> np.ndarray:
    """Rows of the n largest scores, of equal ones the first."""
    if len(scores) <= n:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - n)[len(scores) - n]
    above = np.flatnonzero(scores > least)
    return np.r_[above, np.flatnonzero(scores == least)[: n - len(above)]]


def neighbours(rows: DataFrame, queries: DataFrame, k: int, listed: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found, score their Euclidean distance in double precision.

    rows and queries: vec_id long, v array<double> of one length. A query's own id is no
    candidate; ids that repeat count once; equal distances go to the smaller id; without
    queries or candidates there are no rows.
    """
    schema = "query_id long, vec_id long, score double"
    # k + 1 smallest ids of every vector are enough for any query, which can only be one of them
    of_vector = Window.partitionBy("v").orderBy("vec_id")
    members = rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("_n", F.row_number().over(of_vector)).where(F.col("_n") <= k + 1)
    members = saved(members.withColumn("rep", F.min("vec_id").over(Window.partitionBy("v"))), "ann-members")
    rows = members.where(F.col("_n") == 1).select("vec_id", "v")
    asked = saved(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    queries = saved(asked.groupBy("v").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "v"), "ann-asked")
    n, n_queries = rows.count(), queries.count()
    _, sample = sampled(rows, TRAIN)
    if not len(sample):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = sample.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast(Quantiser(sample))

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = stacked(b["v"], width)
            yield pd.DataFrame({"vec_id": b["vec_id"], "code": [x.tobytes() for x in sent.value.encode(v)], "half": (v**2).sum(1) / 2})

    codes = saved(rows.mapInPandas(encoded, "vec_id long, code binary, half double"), "ann-codes")

    def scanned(key: tuple, cand: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        out_q, out_c, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(cand) and len(query):
            cand = cand.sort_values("vec_id").drop_duplicates("vec_id")
            query = query.drop_duplicates("vec_id")
            ids, half = cand["vec_id"].to_numpy(np.int64), cand["half"].to_numpy()
            packed = np.ascontiguousarray(np.frombuffer(b"".join(cand["code"]), np.uint8).reshape(len(ids), -1).T)
            for part in (query.iloc[i : i + TABLES] for i in range(0, len(query), TABLES)):
                for query_id, table in zip(part["vec_id"], sent.value.tables(stacked(part["v"], width)), strict=True):
                    scores = -half
                    for byte, sums in zip(packed, table, strict=True):
                        scores = scores + sums[byte]
                    best = shortlist(scores, listed + 1)  # one more, since the query's own vector is among them
                    out_q.append(np.full(len(best), query_id))
                    out_c.append(ids[best])
                    out_s.append(scores[best])
        return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_c), "score": np.concatenate(out_s)})

    n_blocks, parts = blocks(n, CODES), blocks(n_queries, QUERIES)
    left = spread(codes, "_block", n_blocks, "_part", parts, 1).groupBy("_block", "_part")
    right = spread(queries, "_part", parts, "_block", n_blocks, 2).groupBy("_block", "_part")
    found = left.cogroup(right).applyInPandas(scanned, schema)
    by_table = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    short = found.withColumn("_at", F.row_number().over(by_table)).where(F.col("_at") <= listed + 1).select("query_id", "vec_id")
    # exact reranking on the original vectors
    with_c = short.join(rows, "vec_id")
    with_q = with_c.join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    squares = F.zip_with("v", "q", lambda a, b: (a - b) * (a - b))
    exact = with_q.select("query_id", F.col("vec_id").alias("rep"), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)).alias("score"))
    # a class's members come after its smallest id, so the k + 1 nearest rows are members of the k + 1 nearest classes
    best = Window.partitionBy("query_id").orderBy(F.asc("score"), F.asc("rep"))
    classes = exact.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= k + 1).select("query_id", "rep", "score")
    nearest = Window.partitionBy("query_id").orderBy(F.asc("score"), F.asc("vec_id"))
    opened = classes.join(members.select("rep", "vec_id"), "rep").withColumn("_at", F.row_number().over(nearest)).where(F.col("_at") <= k + 1)
    lists = saved(opened.groupBy(F.col("query_id").alias("asked")).agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near")), "ann-lists")
    # every query takes the list of its vector, less itself
    named = small(queries.select(F.col("vec_id").alias("asked"), "v"))
    own = asked.join(named, "v").select(F.col("vec_id").alias("query_id"), "asked").join(small(lists), "asked")
    own = own.select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("_at", "x")).select("query_id", (F.col("_at") + 1).alias("rank"), "x.vec_id", "x.score")


def op1_anisotropic_ann(spark, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return neighbours(rows, rows.where(F.col("vec_id") % 100 == 0), 10)
