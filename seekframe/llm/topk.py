"""Exact top-k by inner product: ball trees searched by branch and bound (operator 10).

Every shard of the candidates has a ball tree.  No vector in a ball with centre c and
radius r has an inner product with q above ``q.c + |q| r``; a query visits nodes in the
order of that bound and stops when the next bound is below its k-th best score so far.
The k-th score is shared between shards: queries visit them in rounds, first their home
shard, then ever larger groups of others, and enter each round with the k-th best score
over all shards of the rounds before.

Components are turned into integers first.  Where double precision could round a sum, the
scores of all rows within the rounding error of the bound are taken again in whole numbers,
so scores are exact; one beyond 64 bits is given as the largest or least long.

Results: vectors that are null, empty, or hold a null or a component that is not finite
take no part; a zero vector does.  Only vectors of equal length are compared.  Ties go to
the smaller id; a query is never its own result; with fewer than k candidates it returns
what there is.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekframe.llm import vector_search as vs
from seekframe.llm.runtime import materialise

SHARD_ROWS, LEAF = 4096, 128
#: A round visits so many times as many shards as all before it.
GROWTH = 4
#: Doubles hold whole numbers up to this exactly.
EXACT = 2.0**53


class BallTree:
    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.order = np.arange(len(points))
        centres, radii, self.spans, self.sides = [], [], [], []
        todo, parent = [(0, len(points), -1, 0)], []
        while todo:
            a, b, up, side = todo.pop()
            node = len(centres)
            if up >= 0:
                self.sides[up][side] = node
            own = points[self.order[a:b]]
            centre = own.mean(0)
            distance = np.sqrt(((own - centre) ** 2).sum(1))
            centres.append(centre)
            radii.append(distance.max())
            self.spans.append((a, b))
            self.sides.append([-1, -1])
            parent.append(up)
            if b - a > leaf and radii[-1] > 0:
                one = own[distance.argmax()]
                other = own[((own - one) ** 2).sum(1).argmax()]
                split = np.argsort(own @ (other - one), kind="stable")
                self.order[a:b] = self.order[a:b][split]
                half = (a + b) // 2
                todo += [(half, b, node, 1), (a, half, node, 0)]
        self.sorted = np.ascontiguousarray(points[self.order])
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.slack = 1e-9 * (np.sqrt((self.centres**2).sum(1)) + self.radii + 1)
        self.longest = np.sqrt((points**2).sum(1).max(initial=0.0))

    def search(self, query: np.ndarray, k: int, bound: float, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores that hold all of the k best not below ``bound``.

        ``counts`` says for how many candidates each row stands.  Scores are longs.
        """
        length = np.sqrt(query @ query)
        # how far a sum in double precision can be off; none if all of it are whole numbers below EXACT
        error = 0.0 if length * self.longest < EXACT / 2 else 4e-16 * (len(query) + 2) * length * self.longest
        rows, scores = self._within(query, length, k, bound - 2 * error, counts, error)
        if not error:
            return rows, scores.astype(np.int64)
        whole = [int(x) for x in query]
        sums = [sum(a * int(b) for a, b in zip(whole, self.points[r], strict=True)) for r in rows]
        return rows, np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in sums], np.int64)

    def _within(self, query: np.ndarray, length: float, k: int, bound: float, counts: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray]:
        bounds = (self.centres @ query + length * (self.radii + self.slack) + self.slack).tolist()
        queue = [(-bounds[0], 0)]
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        while queue and -queue[0][0] >= bound:
            _, node = heapq.heappop(queue)
            left, right = self.sides[node]
            if left >= 0:
                heapq.heappush(queue, (-bounds[left], left))
                heapq.heappush(queue, (-bounds[right], right))
                continue
            a, b = self.spans[node]
            value = self.sorted[a:b] @ query
            keep = value >= bound
            if not keep.any():
                continue
            rows = np.concatenate([rows, self.order[a:b][keep]])
            scores = np.concatenate([scores, value[keep]])
            if len(rows) > k or counts[rows].sum() > k:
                order = np.argsort(-scores, kind="stable")
                full = np.searchsorted(np.cumsum(counts[rows[order]]), k)
                if full < len(order):
                    bound = max(bound, scores[order[full]] - 2 * error)
                    keep = scores >= bound
                    rows, scores = rows[keep], scores[keep]
        return rows, scores


def quantised(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))


def top_k(table: DataFrame, queries: Column, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id and score (long) of the k best for each row that ``queries`` marks."""
    vector = F.col(vector_col).cast("array<double>")
    rows = table.where(vs.usable(vector, zero=True) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), quantised(vector, scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    candidates, asked, shards, blocks = vs.dealt(rows, F.col("asks"), SHARD_ROWS)

    def index(ids: np.ndarray, vectors: np.ndarray) -> tuple[vs.Shard, BallTree, np.ndarray]:
        shard = vs.Shard(ids, vectors)
        return shard, BallTree(shard.vectors), np.diff(shard.starts)

    def search(made: tuple[vs.Shard, BallTree, np.ndarray], ids: list[int], vectors: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        shard, tree, counts = made
        out = []
        for query_id, q, bound in zip(ids, vectors, np.nan_to_num(bounds, nan=-np.inf), strict=True):
            # one more than k, as the query itself may be among them
            out.append(shard.best(query_id, *tree.search(q, k + 1, bound, counts), k))
        return out

    best, done, home = None, 0, F.col("shard")
    while done < shards:
        more = min(shards - done, max(1, (GROWTH - 1) * done))
        steps = F.sequence(F.lit(done), F.lit(done + more - 1))
        turn = asked.withColumn("bound", F.lit(None))
        if best is not None:
            known = best.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
            # a long near the largest may round up as a double
            turn = asked.join(known, asked["id"] == known["query_id"], "left").withColumn("bound", F.col("least").cast("double") * F.when(F.abs("least") > int(EXACT), 1 - F.signum("least") * 1e-15).otherwise(1.0))
        turn = turn.select("id", "v", "dim", F.explode(F.transform(steps, lambda x: F.pmod(home + x, F.lit(shards)))).alias("shard"), "block", "bound")
        found = vs.each_shard(candidates, turn, shards, blocks, index, search, "bigint")
        found = vs.merged(found, k) if best is None else _best(vs.merged(found, k), best, k)
        done += more
        if done < shards:
            found = materialise(found, "topk-round")
        best = found
    return best


def _best(one: DataFrame, other: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    both = one.unionByName(other).withColumn("rank", F.row_number().over(order))
    return both.where(F.col("rank") <= k)
