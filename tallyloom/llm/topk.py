"""Exact top-k search by inner product over an impact-ordered, score-at-a-time index.

Components are integers, floor(1024 * x). Vectors are dealt into blocks of bounded size; in a block, each dimension has
postings sorted by component and cut into segments of equal quantised component. A query takes the segments of all
dimensions by descending impact (the most that a posting of the segment can add) and adds every posting's product to its
vector's accumulator. A vector's products that were not added yet are each at most the impact of the next segment, so its
score is at most its accumulator plus that impact times their number. The exact k-th best score of the vectors that lead so
far is a floor. The query stops only when this proves that all but a few vectors lie below the floor; those few are
rescored exactly, so the result is the exact one. Queries in blocks of bounded size meet every block of vectors, and the k
best of each block are merged.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id;
shorter vectors, however long the others are, count as padded with zeros; all rows with the query's own id are its own; a
repeated query id is asked once; ties go to the smaller id; repeated rows under other ids are candidates each for itself; an
empty table gives an empty result; further columns are ignored. Scores are exact while no sum of products reaches 2**53.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block at most; in a block that is only there to keep the cores busy at least; queries in a block, about.
VECTOR_BLOCK, LEAST_BLOCK, QUERY_BLOCK = 32_768, 4_096, 2_048
#: Components in a segment differ by less than this.
WIDTH = 16
#: Postings are taken in this many shares between two looks at the bounds.
SHARES = 24


class ImpactIndex:
    """The index of a block: vectors (n x d, int64) and, by dimension, postings in descending order with segments."""

    def __init__(self, vectors: np.ndarray):
        self.v = vectors
        self.n, self.d = vectors.shape
        ids = np.argsort(-vectors, axis=0, kind="stable").astype(np.int32)
        starts, ends, dims = [], [], []
        for j in range(self.d):
            level = vectors[ids[:, j], j] // WIDTH
            cut = np.flatnonzero(np.diff(level, prepend=level[0] + 1)) if self.n else np.empty(0, np.int64)
            starts.append(cut + j * self.n)
            ends.append((np.append(cut[1:], self.n) if len(cut) else cut) + j * self.n)
            dims.append(np.full(len(cut), j))
        self.start, self.end, self.dim = (np.concatenate(x).astype(np.int64) for x in (starts, ends, dims))
        self.ids = np.ascontiguousarray(ids.T).reshape(-1)
        self.values = np.take_along_axis(vectors, ids.astype(np.int64), 0).T.reshape(-1).astype(np.float64)
        self.read = 0  # postings that queries took, of n x d for each

    def top(self, q: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best (own rows apart), and their exact scores."""
        k = min(k, self.n - len(own))
        if k <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        w = q[self.dim]
        impact = np.maximum(w * self.values[self.start], w * self.values[self.end - 1]) if self.n else w
        order = np.argsort(-impact, kind="stable")
        order = order[w[order] != 0]
        sizes = (self.end - self.start)[order]
        total = np.append(0, np.cumsum(sizes))
        acc, left = np.zeros(self.n), np.full(self.n, np.count_nonzero(q))
        acc[own] = -np.inf
        at, share = 0, max(1, int(total[-1]) // SHARES)
        while at < len(order):
            to = min(len(order), max(at + 1, int(np.searchsorted(total, total[at] + share))))
            seg, size = order[at:to], sizes[at:to]
            picked = np.repeat(self.start[seg] - (total[at:to] - total[at]), size) + np.arange(total[to] - total[at])
            rows = self.ids[picked]
            acc += np.bincount(rows, self.values[picked] * np.repeat(w[seg], size), self.n)
            left -= np.bincount(rows, minlength=self.n)
            at = to
            if 2 * at < len(order):
                continue  # impacts are still positive for the most part
            most = acc + left * (impact[order[at]] if at < len(order) else 0.0)
            lead = np.argpartition(-most, k - 1)[:k]
            floor = (self.v[lead] @ q).min()
            if np.count_nonzero(most >= floor) <= max(4 * k, self.n // 16):
                break
        self.read += int(total[at])
        most = acc + left * (impact[order[at]] if at < len(order) else 0.0)
        lead = np.argpartition(-most, k - 1)[:k]
        alive = np.flatnonzero(most >= (self.v[lead] @ q).min())
        return alive, self.v[alive] @ q


def _matrix(vectors: pd.Series, d: int) -> np.ndarray:
    out = np.zeros((len(vectors), d), np.int64)
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    return out


def search(embeddings: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best rows of ``embeddings`` for each of ``queries`` (same columns): query_id, rank (from 1), vec_id, score."""

    def whole(df: DataFrame) -> DataFrame:
        e = F.col(f"`{vector}`")
        ok = F.col(f"`{id_col}`").isNotNull() & e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.filter(ok).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(e, lambda x: F.floor(F.lit(1024.0) * x.cast("double"))).alias("v"))

    vectors, asked = whole(embeddings), whole(queries).groupBy("id").agg(F.min("v").alias("v"))
    n, cores = vectors.count(), embeddings.sparkSession.sparkContext.defaultParallelism
    v_blocks = max(1, math.ceil(n / VECTOR_BLOCK), min(cores, n // LEAST_BLOCK))
    q_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = vectors.withColumn("vb", block(v_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = asked.withColumn("qb", block(q_blocks)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))

    def run(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(vs) or not len(qs):
            return none
        d = max(vs["v"].map(len).max(), qs["v"].map(len).max(), 1)
        ids, index = vs["id"].to_numpy(), ImpactIndex(_matrix(vs["v"], d))
        rows = []
        for qid, q in zip(qs["id"].to_numpy(), _matrix(qs["v"], d)):
            found, score = index.top(q, k, np.flatnonzero(ids == qid))
            best = np.lexsort((ids[found], -score))[:k]
            rows.append(pd.DataFrame({"query_id": qid, "vec_id": ids[found][best], "score": score[best]}))
        return pd.concat([none, *rows])

    part = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
