"""Nearest neighbours by inner product with vantage-point trees, one per shard.

Vectors are scaled into the unit ball and lifted onto the sphere by one more component, queries are scaled to length one;
then the largest inner product is the smallest distance, and the triangle inequality holds. A tree halves its vectors by
their distance from a vantage point. A half is passed over if the query is, by the inequality, more than ``1 / factor`` times
its reach away: with factor one only where nothing nearer can be, so the search is exact; a larger factor passes over more.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapfold.llm.common import cut, prepare

#: Vectors of a shard, queries that search it at a time, and vectors of a leaf.
SHARD_ROWS, QUERY_ROWS, LEAF = 16_384, 2048, 256
#: Candidates kept beside those asked for, as exact products decide at last.
SPARE = 12
#: Squared distances that differ by less count as equal until exact products decide.
SLACK = 1e-12


class Tree:
    """Vantage-point tree over unit vectors; ids holds the smallest ids of each distinct vector."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, keep: int):
        rows, place = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, place.ravel()))
        groups = np.split(ids[order], np.cumsum(np.bincount(place.ravel()))[:-1])
        scaled = rows / longest
        lift = np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(axis=1)))
        points = np.c_[scaled, lift]
        self.nodes: list[tuple] = []
        self.order = self._build(points, np.random.default_rng(len(rows)))
        self.vectors, self.points = rows[self.order], points[self.order]
        self.ids = [groups[i][: keep + 1] for i in self.order]

    def packed(self) -> bytes:
        return pickle.dumps(self.__dict__)

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.__dict__.update(pickle.loads(data))
        return tree

    def _build(self, points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Nodes: (vantage point, reach of the inner half, nearest of the outer half, inner, outer) or (begin, end)."""
        order = np.arange(len(points))
        self.nodes.append(())
        todo = [(0, 0, len(points))]
        while todo:
            node, a, b = todo.pop()
            if b - a <= LEAF:
                self.nodes[node] = (a, b)
                continue
            own = order[a:b]
            vantage = points[own[rng.integers(len(own))]]
            far = np.linalg.norm(points[own] - vantage, axis=1)
            by = np.argsort(far, kind="stable")
            order[a:b] = own[by]
            middle = (b - a) // 2
            inner, outer = len(self.nodes), len(self.nodes) + 1
            self.nodes += [(), ()]
            self.nodes[node] = (vantage, far[by[middle - 1]], far[by[middle]], inner, outer)
            todo += [(inner, a, a + middle), (outer, a + middle, b)]
        return order

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, ...]:
        """(query row, id, inner product) of the nearest found of each query, its own id left out."""
        lengths = np.linalg.norm(queries, axis=1)
        unit = np.c_[queries / lengths[:, None], np.zeros(len(queries))]
        wide = k + SPARE
        near = np.full((len(queries), wide), np.inf)
        which = np.full((len(queries), wide), -1)
        sole = np.array([x[0] if len(x) == 1 else -1 for x in self.ids])
        alone = np.array([len(x) == 1 for x in self.ids])
        low = np.array([x[0] for x in self.ids])
        second = np.array([x[min(1, len(x) - 1)] for x in self.ids])

        def visit(node: int, active: np.ndarray) -> None:
            if not len(active):
                return
            if len(self.nodes[node]) == 2:
                a, b = self.nodes[node]
                far = np.maximum(0.0, 2 - 2 * (unit[active] @ self.points[a:b].T))
                far = np.sqrt(far)
                far[alone[a:b] & (sole[a:b] == ids[active][:, None])] = np.inf
                every = np.c_[near[active], far]
                place = np.c_[which[active], np.broadcast_to(np.arange(a, b), far.shape)]
                best = np.argpartition(every, wide - 1, axis=1)[:, :wide]
                last = np.partition(every, k - 1, axis=1)[:, k - 1 : k]
                within = (every**2 <= last**2 + SLACK) & np.isfinite(every)
                for r in np.flatnonzero(within.sum(axis=1) > wide).tolist():
                    # more ties than there is room for: exact product, then the smallest id but the query's own
                    at = np.flatnonzero(within[r])
                    own, query = place[r, at], active[r]
                    score = (self.vectors[own] * queries[query]).sum(axis=1)
                    least = np.where(low[own] == ids[query], second[own], low[own])
                    best[r] = at[np.lexsort((least, -score))[:wide]]
                near[active] = np.take_along_axis(every, best, 1)
                which[active] = np.take_along_axis(place, best, 1)
                return
            vantage, reach, begin, inner, outer = self.nodes[node]
            far = np.linalg.norm(unit[active] - vantage, axis=1)
            first = far <= (reach + begin) / 2
            visit(inner, active[first])
            visit(outer, active[~first])
            limit = np.sqrt(np.partition(near[active], k, axis=1)[:, k] ** 2 + SLACK) + 1e-9
            visit(inner, active[~first & (factor * (far - reach) <= limit)])
            visit(outer, active[first & (factor * (begin - far) <= limit)])

        visit(0, np.arange(len(queries)))
        rows, found, scores = [], [], []
        for i in range(len(queries)):
            at = which[i][np.isfinite(near[i])]
            score = (self.vectors[at] * queries[i]).sum(axis=1)
            some = [(s, v) for s, j in zip(score.tolist(), at.tolist(), strict=True) for v in self.ids[j].tolist() if v != ids[i]]
            some = sorted(some, key=lambda x: (-x[0], x[1]))[:k]
            rows += [i] * len(some)
            found += [v for _, v in some]
            scores += [s for s, _ in some]
        return np.array(rows, int), np.array(found, np.int64), np.array(scores, float)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, vector): rows that take part; of rows with the same id the one with the smallest vector."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).select("vec_id", F.size("vector").alias("dim"), "vector")


def nearest(vectors: DataFrame, queries: str, k: int = 20, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that the condition ``queries`` selects.

    ``vectors`` has vec_id and embedding; other columns are not read. Vectors that are null, zero or hold null or non-finite
    components, and rows without an id, take no part; vectors are compared with those of the same length. score is the inner
    product in double precision; ties go to the smaller vec_id, and of identical vectors no more are kept than can be among
    the k. Every query meets every shard, in blocks: both sides are dealt out by (shard, block), so a task holds one tree and
    at most about QUERY_ROWS queries.
    """
    prepare(vectors.sparkSession)
    rows = cut(usable(vectors))
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    if not sizes["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = rows.where(queries)
    shards, blocks = -(-sizes["n"] // SHARD_ROWS), max(1, -(-asked.count() // QUERY_ROWS))
    longest = float(np.sqrt(sizes["m"])) * (1 + 1e-12)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(part["vec_id"].to_numpy(np.int64), np.stack(part["vector"].to_numpy()).astype(float), longest, k)
        return pd.DataFrame({"dim": [part["dim"].iloc[0]], "shard": [part["shard"].iloc[0]], "tree": [tree.packed()]})

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    trees = cut(sharded.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary"))
    trees = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(tree: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(tree) or not len(part):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids = part["vec_id"].to_numpy(np.int64)
        row, found, score = Tree.unpacked(tree["tree"].iloc[0]).search(ids, np.stack(part["vector"].to_numpy()).astype(float), k, factor)
        return pd.DataFrame({"query_id": ids[row], "vec_id": found, "score": score})

    by = ["dim", "shard", "block"]
    found = trees.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
