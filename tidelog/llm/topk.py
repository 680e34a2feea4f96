"""Exact top-k inner products by no-random-access aggregation (NRA, Fagin et al.).

Vectors become integers, floor(scale * x). Queries and candidates meet in the cells of a grid (fragment and replicate): each
cell holds a bounded number of both. In a cell, each component is a list of candidates sorted by its contribution; lists are
read in step from their best ends, to a twentieth first and then to thrice the depth before, for many queries at once. A
candidate's lower bound takes the list's worst value for each list it wasn't yet met in, its upper bound the value last read
there; at one depth these values are the same for all queries of one sign, so the bounds of all pairs are a matrix product. After
each step, reading stops for the queries that leave only a few candidates whose upper bound reaches the k-th lower bound; the
scores of the few are resolved.

A query first visits one cell; its k-th score there is passed on to the other cells as a bar that outsiders must reach, so those
mostly stop before they have k of their own. The cells' lists are merged by score, ties to the smaller id.

How deep the lists are read depends on the vectors: a part of them where few components tell most of a score, all of them
where many components vary alike. Products too large for exact floating point widen the bounds by the largest rounding error,
and the few scores are resolved in whole numbers.

Vectors that are null or hold null or non-finite components take no part, nor do null ids. Only vectors of equal length are
compared. Repeated candidate rows count each; of repeated query rows the least vector stands. Scores beyond 64 bits saturate.
Other columns, also those named as the operator's own, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_width

#: Candidates and queries of one cell at most (on average, as they are dealt by hash).
CELL_CANDIDATES, CELL_QUERIES = 32_768, 65_536
#: Candidates of one cell at least, where fewer cells would leave cores idle.
LEAST_CANDIDATES = 2_048
#: The first depth, as a part of the lists, its growth from step to step, and candidates (in k) that are few enough to resolve.
FIRST_DEPTH, DEPTH_GROWTH, FEW = 20, 3, 4
#: Bounds that are held at once (queries x candidates), and values of candidates that they are made of (x dimensions).
BOUND_ELEMENTS = 1 << 21
MOST = (1 << 63) - 1
RESULT = "query_id long, vec_id long, score long"


class Lists:
    """The sorted lists of a cell's candidates."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.table = matrix.astype(np.float64)
        self.values = np.sort(np.ascontiguousarray(self.table.T), axis=1)
        self.largest = np.abs(self.values[:, [0, -1]]).max(1, initial=0) if len(ids) else np.zeros(matrix.shape[1])

    def bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores, a row for each query, when every list is read to a depth from its best end.

        A value was met if it is at least (at most, where the query is negative) the one last read. The upper bound takes the
        last value read for others, the lower bound the list's worst.
        """
        n, d = self.table.shape
        if depth >= n:
            scores = queries @ self.table.T
            return scores, scores
        high, low, top, bottom = self.values[:, n - depth], self.values[:, depth - 1], self.values[:, -1], self.values[:, 0]
        signed = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], 1)
        floor, ceiling = np.empty((len(queries), n)), np.empty((len(queries), n))
        step = max(1, BOUND_ELEMENTS // (2 * d))
        for i in range(0, n, step):
            t = self.table[i : i + step]
            ceiling[:, i : i + step] = signed @ np.concatenate([np.maximum(t, high), np.minimum(t, low)], 1).T
            floor[:, i : i + step] = signed @ np.concatenate([np.where(t >= high, t, bottom), np.where(t <= low, t, top)], 1).T
        return floor, ceiling

    def nra(self, query: np.ndarray, own: np.ndarray, k: int, bar: float = -np.inf) -> tuple[np.ndarray, float]:
        """(positions of the candidates that may be among the k best and reach the bar, share of the lists that was read)."""
        return next(self.nra_of(query[None], [np.flatnonzero(own)], k, np.array([bar])))[1:]

    def nra_of(self, queries: np.ndarray, own: list[np.ndarray], k: int, bars: np.ndarray) -> Iterator[tuple[int, np.ndarray, float]]:
        """(number of the query, what nra returns for it) of many queries, those that stop first at the front. own: positions of each one's own rows."""
        n = len(self.table)
        most = np.abs(queries) @ self.largest
        slack = np.where(most < 2**53, 0.0, most * (queries.shape[1] + 4) * 2.0**-50)
        step = max(1, BOUND_ELEMENTS // n)
        for i in range(0, len(queries), step):
            open_ = np.arange(i, min(len(queries), i + step))
            bar, depth = bars[open_].copy(), min(n, max(16, n // FIRST_DEPTH))
            while len(open_):
                floor, ceiling = self.bounds(queries[open_], depth)
                mine = np.repeat(np.arange(len(open_)), [len(own[q]) for q in open_]), np.concatenate([own[q] for q in open_])
                if n > k:
                    floor[mine] = -np.inf
                    bar = np.maximum(bar, np.minimum(np.partition(floor, n - k, axis=1)[:, n - k], float(MOST)))
                left = ceiling >= (np.where(bar <= -MOST, -np.inf, bar) - 2 * slack[open_])[:, None]
                left[mine] = False
                done = np.ones(len(open_), bool) if depth == n else np.count_nonzero(left, axis=1) <= FEW * k
                for j in np.flatnonzero(done).tolist():
                    yield int(open_[j]), np.flatnonzero(left[j]), depth / n
                open_, bar, depth = open_[~done], bar[~done], min(n, depth * DEPTH_GROWTH)

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products, within 64 bits."""
        if float(np.abs(query.astype(np.float64)) @ self.largest) < 2**53:
            return self.matrix[at].astype(np.int64) @ query
        exact = self.matrix[at].astype(object) @ query.astype(object)
        return np.array([min(max(int(x), -MOST - 1), MOST) for x in exact], np.int64)


def cell_top(query_ids: np.ndarray, queries: np.ndarray, bars: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> list[list]:
    """(query id, candidate id, score) columns of each query's k best in a cell, of those that reach its bar."""
    out: list[list] = [[], [], []]
    lists = Lists(ids, matrix)
    at = np.argsort(ids, kind="stable")
    own = [at[a:b] for a, b in zip(np.searchsorted(ids[at], query_ids, "left"), np.searchsorted(ids[at], query_ids, "right"), strict=True)]
    if not matrix.shape[1]:
        found = ((i, np.setdiff1d(np.arange(len(ids)), x), 1.0) for i, x in enumerate(own))
    else:
        found = lists.nra_of(queries.astype(np.float64), own, k, bars)
    for i, left, _ in found:
        q, v = query_ids[i], queries[i]
        scores = lists.scores(left, v)
        best = np.lexsort((ids[left], ~scores))[:k]
        out[0] += [int(q)] * len(best)
        out[1] += ids[left][best].tolist()
        out[2] += scores[best].tolist()
    return out


def top_inner_products(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose vec_id is divisible by every, against all other rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = vectors.where(F.coalesce(good, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("v"), F.size(x).alias("dim")
    )
    asked = whole.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by(F.struct("v", "dim"), F.col("v")).alias("m")).select("vec_id", "m.v", "m.dim")
    asked = scratch.keep(asked, "asked")
    n, m = whole.count(), asked.count()
    c = max(1, ceil(n / CELL_CANDIDATES), min(ceil(n / LEAST_CANDIDATES), 4 * shuffle_width(spark)))
    b = max(1, ceil(m / CELL_QUERIES))
    part = lambda width, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(width)).cast("int")
    all_of = lambda width: F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    left = whole.withColumn("c", part(c, 1)).withColumn("b", all_of(b))
    asked = asked.withColumn("b", part(b, 2)).withColumn("home", part(c, 1))

    def cell(key, candidates, queries):
        out = [[], [], []]
        if candidates.num_rows and queries.num_rows:
            matrix = lambda t: np.array(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, key[2].as_py())
            bars = queries.column("bar").to_numpy()
            out = cell_top(queries.column("vec_id").to_numpy(), matrix(queries), bars, candidates.column("vec_id").to_numpy(), matrix(candidates), k)
        return pa.table({a: pa.array(v, pa.int64()) for a, v in zip(("query_id", "vec_id", "score"), out, strict=True)})

    def met(queries: DataFrame) -> DataFrame:
        return left.groupBy("c", "b", "dim").cogroup(queries.select("vec_id", "v", "dim", "c", "b", "bar").groupBy("c", "b", "dim")).applyInArrow(cell, RESULT)

    found = scratch.keep(met(asked.withColumn("c", F.col("home")).withColumn("bar", F.lit(float("-inf")))), "home")
    if c > 1:
        bars = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("bar"))
        # a double next to a large score may lie above it: one unit in the last place below is a bar still
        lower = F.col("bar") - F.abs("bar") * 2.0**-52
        others = asked.join(bars, "vec_id", "left").withColumn("bar", F.coalesce(lower, F.lit(float("-inf")))).withColumn("c", all_of(c)).where("c <> home")
        found = found.unionByName(met(others))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
