"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Components become integers floor(scale * x), so scores are exact.  Vectors are
dealt into shards of at most about ``shard_rows`` rows; a task builds the ball
tree of a shard and searches it for a block of queries.  A node with centre c and
radius r can score at most q.c + |q| r; nodes are visited in falling order of
that bound and left out once it is below the query's current k-th score.

The k-th scores are shared in two rounds: first every query block searches one
pilot shard, and the scores found there are the floor with which all other
shards are searched.  Shards and query blocks meet by key; a group is one shard
and one block, both of bounded size, and gives at most k rows a query.

Defined cases: vectors that are null, empty or hold a null or non-finite
component take no part, neither do rows with a null id; with fewer than k
candidates all are returned; equal scores go to the smaller id; a row with a
repeated id is a candidate of its own (never of a query with the same id);
vectors of another length than the query's are compared over the shorter length
as if padded with zeros; an empty table gives no rows; further columns are not
used.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsift.llm.shared import materialize

SCALE = 1024
SHARD_ROWS = 8192
BLOCK_ROWS = 2048
LEAF_ROWS = 64


class BallTree:
    """Levels of (centre, radius) over the rows of a shard, halved along the widest spread until leaves are small."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.levels: list[list[tuple[int, int]]] = [[(0, len(points))]]
        while max(b - a for a, b in self.levels[-1]) > leaf:
            below = []
            for a, b in self.levels[-1]:
                own = points[self.order[a:b]]
                middle = (a + b) // 2
                if b - a > 1:
                    far = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                    other = own[((own - far) ** 2).sum(axis=1).argmax()]
                    self.order[a:b] = self.order[a:b][np.argsort(own @ (other - far), kind="stable")]
                below += [(a, middle), (middle, b)]
            self.levels.append(below)
        self.points = points[self.order]
        self.balls = []
        for level in self.levels:
            centres = np.stack([self.points[a:b].mean(axis=0) if b > a else np.zeros(points.shape[1]) for a, b in level])
            radii = np.array([np.sqrt(((self.points[a:b] - c) ** 2).sum(axis=1).max()) if b > a else -1.0 for (a, b), c in zip(level, centres)])
            self.balls.append((centres, radii))

    def search(self, queries: np.ndarray, own_ids: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray):
        """Best k (score, id) of each query as arrays, -inf where there are fewer; scores below ``floor`` may be left out."""
        ids = ids[self.order]
        norms = np.sqrt((queries**2).sum(axis=1))[:, None]
        best = np.full((len(queries), k), -np.inf)
        names = np.full((len(queries), k), np.iinfo(np.int64).max)
        bound = None
        for centres, radii in self.balls:
            here = queries @ centres.T + norms * radii + 1e-3  # the margin covers rounding
            here[:, radii < 0] = -np.inf
            bound = here if bound is None else np.minimum(here, np.repeat(bound, 2, axis=1))
            bound = np.where(bound >= floor[:, None], bound, -np.inf)  # a cut branch stays cut
        visit = np.argsort(-bound, axis=1, kind="stable")
        open_queries = np.arange(len(queries))
        for turn in range(visit.shape[1]):
            leaf = visit[open_queries, turn]
            go = bound[open_queries, leaf] >= np.maximum(best[open_queries, -1], floor[open_queries])
            go &= bound[open_queries, leaf] > -np.inf
            open_queries, leaf = open_queries[go], leaf[go]  # bounds fall from here on
            if not len(open_queries):
                break
            for node in np.unique(leaf):
                rows = open_queries[leaf == node]
                a, b = self.levels[-1][node]
                scores = queries[rows] @ self.points[a:b].T
                scores[own_ids[rows][:, None] == ids[a:b]] = -np.inf
                both = np.hstack([best[rows], scores])
                labels = np.hstack([names[rows], np.broadcast_to(ids[a:b], scores.shape)])
                top = np.lexsort((labels, -both), axis=1)[:, :k]
                best[rows], names[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(labels, top, 1)
        return best, names


def _matrix(cells, width: int | None = None) -> np.ndarray:
    width = width or max(map(len, cells), default=0)
    out = np.zeros((len(cells), width))
    for row, cell in zip(out, cells):
        n = min(len(cell), width)
        row[:n] = cell[:n]
    return out


def _search(k: int) -> Callable:
    def run(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(shard) or not len(block):
            return empty
        shard, block = shard.sort_values("vec_id", kind="stable"), block.sort_values("query_id", kind="stable")
        points = _matrix(shard["vec"].to_numpy())
        queries = _matrix(block["vec"].to_numpy(), points.shape[1])
        own = block["query_id"].to_numpy()
        floor = block["floor"].fillna(-np.inf).to_numpy(float)
        best, names = BallTree(points).search(queries, own, shard["vec_id"].to_numpy(), k, floor)
        real = best > -np.inf
        row, _ = np.nonzero(real)
        return pd.DataFrame({"query_id": own[row], "vec_id": names[real], "score": best[real].astype("int64")})

    return run


def _usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & finite


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE,
          shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every query row."""
    whole = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("int"))
    used = vectors.where(_usable(F.col(vec_col)) & F.col(id_col).isNotNull())
    rows = materialize(used.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_rows))
    deal = lambda col, seed, parts: F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(parts)).cast("int")
    queries = rows.where("asks").select(F.col("vec_id").alias("query_id"), "vec", deal("vec_id", 1, blocks).alias("block"))
    candidates = rows.select("vec_id", "vec", deal("vec_id", 2, shards).alias("shard"))
    schema = "query_id long, vec_id long, score long"

    def meet(cands: DataFrame, asks: DataFrame, shard_ids: Column) -> DataFrame:
        left = cands.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = asks.withColumn("shard", F.explode(shard_ids))
        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_search(k), schema)

    pilot_of = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    left = candidates.withColumn("block", F.explode(F.sequence(F.col("shard"), F.lit(blocks - 1), F.lit(shards)))) if blocks > shards else \
        candidates.where(F.col("shard") < blocks).withColumn("block", F.col("shard"))
    right = queries.withColumns({"shard": pilot_of, "floor": F.lit(None).cast("double")})
    pilot = materialize(left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_search(k), schema), "pilot")
    floors = pilot.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    found = pilot
    if shards > 1:
        asks = materialize(queries.join(floors, "query_id", "left"), "queries")
        others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.pmod(F.col("block"), F.lit(shards)))
        found = pilot.unionByName(meet(candidates, asks, others))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
