"""What the two vector searches share: usable rows, shards, and merging what shards found.

Candidates are dealt by a hash of their id into shards of some thousands.  A task gets a
shard's candidates first and builds their index once; then the queries stream past it, so
its memory is bounded by the shard, and rows of one very common vector are spread over all
shards.  Only beyond ``BLOCK_ROWS`` queries are these cut into blocks, each of which builds
the index again, as one task would have too much to do.  Within a shard equal vectors are
kept once with their ids in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 18


def usable(vector: Column, *, zero: bool) -> Column:
    """Neither null nor empty, all components finite; a zero vector only if ``zero``."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fine = vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))
    return fine if zero else fine & F.exists(vector, lambda x: x != 0)


class Shard:
    """The distinct vectors of a shard, each with its ids in ascending order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order]) + 0.0
        keys = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        self.vectors = vectors[first]
        by_group = np.argsort(group, kind="stable")
        self.ids, self.starts = ids[by_group], np.concatenate([[0], np.cumsum(np.bincount(group))])

    def best(self, query_id: int, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k ids of highest score, ties to the smaller id, the query itself left out."""
        if len(rows) > k + 1:
            counts = self.starts[rows + 1] - self.starts[rows]
            order = np.argsort(-scores, kind="stable")
            enough = np.searchsorted(np.cumsum(counts[order]), k + 1)
            if enough < len(order):
                keep = scores >= scores[order[enough]]
                rows, scores = rows[keep], scores[keep]
        ids, all_scores = [], []
        for r, s in zip(rows, scores, strict=True):
            own = self.ids[self.starts[r] : min(self.starts[r + 1], self.starts[r] + k + 1)]
            ids.append(own)
            all_scores.append(np.full(len(own), s))
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0)
        found, value = np.concatenate(ids), np.concatenate(all_scores)
        value = value[found != query_id]
        found = found[found != query_id]
        order = np.lexsort((found, -value))[:k]
        return found[order], value[order]


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def dealt(vectors: DataFrame, queries: Column, shard_rows: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Candidates (id, v, dim, shard), queries (id, v, dim, home shard, block), and how many shards and blocks there are.

    ``vectors`` has ``id`` and ``v``.  Vectors of different lengths are never compared.
    """
    counts = vectors.agg(F.count(F.lit(1)), F.count(F.when(queries, 1))).first()
    shards, blocks = max(1, math.ceil(counts[0] / shard_rows)), max(1, math.ceil(counts[1] / BLOCK_ROWS))
    dim, shard = F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    return vectors.select("id", "v", dim, shard), vectors.where(queries).select("id", "v", dim, shard, block), shards, blocks


def each_shard(candidates: DataFrame, asked: DataFrame, shards: int, blocks: int, index: Callable, search: Callable, score: str) -> DataFrame:
    """query_id, vec_ids and scores that ``search(index, ids, vectors, bounds)`` finds for the rows of ``asked``.

    ``asked`` has id, v, dim, shard (where to look), block and bound (null: none); ``index(ids,
    vectors)`` is made once for a shard and a block.  Candidates come first in the order of a
    partition, so that they are held, and queries are not.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    held = candidates.select("dim", "shard", copies, F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("bound"))
    rows = held.unionByName(asked.select("dim", "shard", "block", F.lit(1).alias("kind"), "id", "v", F.col("bound").cast("double").alias("bound")))
    # a task for each shard and block: by a hash several might meet in one task
    rows = rows.withColumn("task", F.col("shard") * blocks + F.col("block")).repartitionById(shards * blocks, "task").sortWithinPartitions("task", "dim", "kind").drop("task")
    kind = pa.int64() if score == "bigint" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, vectors, made = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "block", "kind")])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])) if batch.num_rows else []
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                part, key = batch.slice(a, b - a), tuple(keys[:3, a])
                if key != here:
                    here, ids, vectors, made = key, [], [], None
                if keys[3, a] == 0:
                    ids.append(part.column("id").to_numpy())
                    vectors.append(matrix(part.column("v")))
                    continue
                if not ids:  # vectors of a length that nothing else here has
                    continue
                if made is None:
                    made = index(np.concatenate(ids), np.concatenate(vectors))
                    vectors.clear()
                for first in range(0, part.num_rows, 256):
                    some = part.slice(first, 256)
                    found = search(made, some.column("id").to_pylist(), matrix(some.column("v")), some.column("bound").to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([some.column("id"), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(kind))], ["query_id", "vec_ids", "scores"])

    return rows.mapInArrow(run, f"query_id bigint, vec_ids array<bigint>, scores array<{score}>")


def merged(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the k best over all that shards found."""
    rows = found.select("query_id", F.explode(F.arrays_zip(F.col("scores"), F.col("vec_ids"))).alias("x")).select("query_id", F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
