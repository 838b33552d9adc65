"""Approximate nearest neighbours by a forest of random-projection trees (operator 4).

Every shard of the candidates has its own forest: at each level of a tree the points of a node
are halved at their median along the tree's random direction for that level, until a leaf is
small.  One priority queue holds the leaves of all trees of a shard: first comes the leaf whose
points lie on average closest in direction to the query.  Leaves are taken off the queue until
a fraction of the shard has been met; all candidates met are then ranked by the exact inner
product in double precision.  For vectors of unequal length the trees see each vector with one
more component that makes all lengths equal, so that the nearest in angle have the largest
inner product.

``python -m seekframe.llm.recall FOLDER`` measures recall against brute force.

Results: vectors that are null, empty, zero, or hold a null or a component that is not
finite take no part, as query or as candidate.  Ties go to the smaller id; equal vectors
under several ids are all candidates, kept once per shard with their ids.  With fewer
than k candidates a query returns what there is; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekframe.llm import vector_search as vs

SHARD_ROWS = 8192
TREES, LEAF = 32, 16
#: The share of a shard's distinct vectors that a query meets, and the least number of them.
FRACTION, LEAST = 0.2, 600
#: Leaves taken off the queue at a time.
STEP = 8


class Forest:
    """The leaves of all trees: their rows, and the unit vector along the sum of their points."""

    def __init__(self, points: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 5):
        squares = (points**2).sum(1)
        # one more component makes all lengths equal
        full = np.hstack([points, np.sqrt(np.maximum(0, squares.max(initial=0.0) - squares))[:, None]])
        n, random = len(full), np.random.default_rng(seed)
        depth = max(0, math.ceil(math.log2(n / leaf)))
        units, rows = [], []
        for _ in range(trees):
            along = full @ random.standard_normal((full.shape[1], depth))
            order, bounds = np.arange(n), np.array([0, n])
            for level in range(depth):
                node = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                order = order[np.lexsort((along[order, level], node))]
                bounds = np.sort(np.concatenate([bounds, (bounds[:-1] + bounds[1:]) // 2]))
            sums = np.add.reduceat(full[order], bounds[:-1], axis=0)
            units.append((sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300))[:, :-1])
            sizes = np.diff(bounds)
            # a shorter leaf repeats its last row
            rows.append(order[bounds[:-1, None] + np.minimum(np.arange(sizes.max()), sizes[:, None] - 1)])
        self.n, self.units, self.rows = n, np.vstack(units), np.vstack(rows).astype(np.int32)

    def candidates(self, nearness: np.ndarray, wanted: int) -> np.ndarray:
        """About ``wanted`` distinct rows (all there are, if fewer), given how near each leaf is to the query."""
        met = np.zeros(self.n, bool)
        at = taken = 0
        while taken < len(nearness):
            # the front of the queue, in order; what is behind it is looked at only if need be
            taken = min(len(nearness), max(64, 4 * taken, 2 * wanted // self.rows.shape[1]))
            front = np.argpartition(-nearness, taken - 1)[:taken] if taken < len(nearness) else np.arange(taken)
            queue = front[np.argsort(-nearness[front], kind="stable")]
            while at < taken:
                met[self.rows[queue[at : at + STEP]].ravel()] = True
                at += STEP
                if np.count_nonzero(met) >= wanted:
                    return np.flatnonzero(met)
            at = taken
        return np.flatnonzero(met)


def nearest(table: DataFrame, queries, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, fraction: float = FRACTION, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found to each row that ``queries`` (a column) marks."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(vs.usable(F.col("v"), zero=False) & F.col("id").isNotNull())
    candidates, asked, shards, blocks = vs.dealt(rows, F.col("asks"), SHARD_ROWS)
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("bound", F.lit(None))

    def index(ids: np.ndarray, vectors: np.ndarray) -> tuple[vs.Shard, Forest]:
        shard = vs.Shard(ids, vectors)
        return shard, Forest(shard.vectors, trees)

    def search(made: tuple[vs.Shard, Forest], ids: list[int], vectors: np.ndarray, _: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        shard, forest = made
        wanted = max(least, int(fraction * len(shard.vectors)))
        nearness = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ forest.units.T
        out = []
        for query_id, q, near in zip(ids, vectors, nearness, strict=True):
            met = forest.candidates(near, wanted)
            out.append(shard.best(query_id, met, shard.vectors[met] @ q, k))
        return out

    return vs.merged(vs.each_shard(candidates, asked, shards, blocks, index, search, "double"), k)
