"""Operator 9: nearest neighbours by inner product with a vantage-point tree per shard.

Inner products become distances by one more coordinate that lifts every vector of a shard to the same norm R; a query
gets 0 there, so |q - x|^2 = |q|^2 + R^2 - 2 <q, x>. A tree splits its points at the median distance from a vantage
point. A query goes to its nearer side first; the other side is skipped when the triangle inequality keeps all
its points farther than ``factor`` times the k-th distance found so far. ``factor`` 1 skips only what cannot count
(exact search); less skips more. All queries of a task walk the tree together, so the arithmetic is matrix
products over leaves.

Spark deals the work: equal vectors are first collapsed (with the k + 1 least ids each, which is all that can count), then
split by hash into shards of bounded size; queries are split into blocks; a task searches one block in one shard, and
the best of all shards meet in a window per query. No task's input grows with the table.

Nulls and edge cases: rows with a null id, and vectors null, empty, zero, or with null or non-finite components, take no
part, not as queries either; vectors of another length than the query's are no candidates; rows equal in id and vector
count once; candidates with the query's id are left out; fewer candidates than k give fewer rows; empty tables
give empty tables; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.session import durable

K = 20
FACTOR = 0.2  # measured recall 0.99; see the README
SHARD_ROWS, QUERY_BLOCK, LEAF = 16_384, 4_096, 256


@dataclass
class Tree:
    points: np.ndarray | None = None  # of a leaf: rows of the matrix
    vantage: int = -1
    inner: Tree | None = None
    outer: Tree | None = None
    inner_most: float = 0.0  # greatest distance of the inner side, least of the outer one
    outer_least: float = 0.0


def build(lifted: np.ndarray, rows: np.ndarray, leaf: int = LEAF, seed: int = 1) -> Tree:
    if len(rows) <= leaf:
        return Tree(points=np.sort(rows))
    vantage = int(rows[seed * 7919 % len(rows)])
    far = np.sqrt(((lifted[rows] - lifted[vantage]) ** 2).sum(axis=1))
    order = np.argsort(far, kind="stable")
    half = len(rows) // 2
    a, b = order[:half], order[half:]
    inner, outer = build(lifted, rows[a], leaf, 2 * seed), build(lifted, rows[b], leaf, 2 * seed + 1)
    return Tree(None, vantage, inner, outer, float(far[a[-1]]), float(far[b[0]]))


class Search:
    """The k best rows of a matrix for many queries; ties go to the smaller row number."""

    def __init__(self, matrix: np.ndarray, k: int, factor: float, leaf: int = LEAF):
        norms = (matrix**2).sum(axis=1)
        self.top = float(norms.max())
        self.matrix, self.k, self.factor = matrix, k, factor
        self.lifted = np.column_stack([matrix, np.sqrt(np.maximum(self.top - norms, 0.0))])
        self.tree = build(self.lifted, np.arange(len(matrix)), leaf)

    def run(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(queries)
        self.queries, self.norms = queries, (queries**2).sum(axis=1)
        self.score = np.full((n, self.k), -np.inf)
        self.row = np.full((n, self.k), len(self.matrix))
        self._visit(self.tree, np.arange(n))
        return self.score, self.row

    def _reach(self, who: np.ndarray) -> np.ndarray:
        kth = self.score[who, -1]
        return np.sqrt(np.maximum(self.norms[who] + self.top - 2 * kth, 0.0)) * self.factor + 1e-9

    def _visit(self, node: Tree, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.points is not None:
            self._look(node.points, who)
            return
        dots = self.queries[who] @ self.matrix[node.vantage]
        far = np.sqrt(np.maximum(self.norms[who] + self.top - 2 * dots, 0.0))
        near_inner = far <= (node.inner_most + node.outer_least) / 2
        self._visit(node.inner, who[near_inner])
        self._visit(node.outer, who[~near_inner])
        reach = self._reach(who)
        self._visit(node.outer, who[near_inner & (node.outer_least - far <= reach)])
        self._visit(node.inner, who[~near_inner & (far - node.inner_most <= reach)])

    def _look(self, points: np.ndarray, who: np.ndarray) -> None:
        found = self.queries[who] @ self.matrix[points].T
        better = (found >= self.score[who, -1][:, None]).any(axis=1)
        who, found = who[better], found[better]
        if not len(who):
            return
        scores = np.concatenate([self.score[who], found], axis=1)
        rows = np.concatenate([self.row[who], np.broadcast_to(points, found.shape)], axis=1)
        best = np.lexsort((rows, -scores), axis=1)[:, : self.k]
        self.score[who] = np.take_along_axis(scores, best, axis=1)
        self.row[who] = np.take_along_axis(rows, best, axis=1)


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search_shard(index: pa.Table, asked: pa.Table, k: int, factor: float) -> pa.Table:
    if not index.num_rows or not asked.num_rows:
        return _FOUND.empty_table()
    ids = index["ids"].combine_chunks().to_pylist()
    order = np.array(sorted(range(len(ids)), key=lambda i: ids[i][0]))  # so that row numbers follow the least ids
    matrix, queries = _matrix(index["v"], len(ids))[order], _matrix(asked["v"], asked.num_rows)
    _, rows = Search(matrix, min(k + 1, len(ids)), factor).run(queries)
    out: list[tuple[list, list, list]] = []
    for q, own in enumerate(asked["query_id"].to_pylist()):
        hit = rows[q][rows[q] < len(ids)]
        scores = (matrix[hit] * queries[q]).sum(axis=1)  # the reported measure, summed row by row
        members = [ids[order[r]] for r in hit]
        vec = np.array([i for m in members for i in m], np.int64)
        score = np.repeat(scores, [len(m) for m in members])
        keep = vec != own
        best = np.lexsort((vec[keep], -score[keep]))[:k]
        out.append(([own] * len(best), vec[keep][best], score[keep][best]))
    return pa.table([np.concatenate([np.asarray(o[c]) for o in out]) for c in range(3)], schema=_FOUND)


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # not NaN either: NaN is above all
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, asked: Column, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_rows: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of every row for which ``asked`` holds."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0)  # -0.0 becomes 0.0
    rows = vectors.select("vec_id", v.alias("v"), asked.alias("_asked")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = durable(rows)
    order = Window.partitionBy("v").orderBy("vec_id")
    least = rows.select("v", "vec_id").withColumn("_n", F.dense_rank().over(order)).filter(F.col("_n") <= k + 1)
    index = durable(least.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")))
    queries = rows.filter("_asked").select(F.col("vec_id").alias("query_id"), "v").distinct()
    shards = max(1, math.ceil(index.count() / shard_rows))
    blocks = max(1, math.ceil(rows.filter("_asked").count() / block_rows))
    dealt = index.select(
        "ids", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    put = queries.select(
        "query_id", "v", F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
    )
    key = ["dim", "shard", "block"]
    found = dealt.groupBy(*key).cogroup(put.groupBy(*key)).applyInArrow(
        lambda left, right: _search_shard(left, right, k, factor), "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
