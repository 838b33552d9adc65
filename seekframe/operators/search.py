"""Ranked retrieval legs.  Each takes a corpus and a table of queries and returns one ranked list per query.

The corpus side is never exploded whole: only tokens that some query asks for leave a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekframe.functions import text as T
from seekframe.functions.tables import step

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def top(hits: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first ``k`` rows of each query with their ``rank``."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, fields: Mapping[str, tuple[Column, float]], k: int = 20, *, id_col: str = "doc_id", keep: Column | None = None, prefix: bool = False) -> DataFrame:
    """query_id, id, score, shown, rank: BM25 over weighted fields, all terms required.

    ``queries`` has query_id and terms (array); with ``prefix`` a term matches all words it begins.
    ``keep`` filters what may be returned, not what statistics are taken from.
    """
    asked = queries.select("query_id", F.explode("terms").alias("term"))
    wanted = queries.agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("wanted"))
    parts = docs.select(F.col(id_col).alias("id"), (keep if keep is not None else F.lit(True)).alias("keep"), *[T.terms(c).alias(f) for f, (c, _) in fields.items()])
    length = sum((F.size(f) for f in fields), F.lit(0))
    match = (lambda w, t: F.exists(w, lambda x: F.startswith(t, x))) if prefix else (lambda w, t: F.array_contains(w, t))

    def tag(field: str, weight: float) -> Column:
        met = F.filter(field, lambda t: match(F.col("wanted"), t))
        return F.transform(met, lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("w")))

    # one scan of the texts: a narrow table of lengths and wanted terms, from which all statistics come
    tagged = F.flatten(F.array(*[tag(f, w) for f, (_, w) in fields.items()]))
    one = step(parts.crossJoin(wanted).select("id", "keep", length.alias("length"), tagged.alias("met")), "bm25-terms")
    totals = one.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))
    hits = one.select("id", "keep", "length", F.explode("met").alias("x")).select("id", "keep", "length", F.col("x.term").alias("word"), F.col("x.w").alias("w"))
    on = F.startswith(F.col("word"), F.col("term")) if prefix else F.col("word") == F.col("term")
    counts = hits.join(asked, on).groupBy("query_id", "term", "id", "keep", "length").agg(F.sum("w").alias("f"))
    # one row for each term of a query; a term that stands in most documents is counted before it is shuffled
    found_in = counts.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    scored = counts.join(found_in, ["query_id", "term"]).crossJoin(totals)  # one row
    idf = F.greatest(F.lit(IDF_FLOOR), F.ln((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    needed = queries.select("query_id", F.size("terms").alias("needed"))
    per_doc = scored.where("keep").groupBy("query_id", "id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("met"))
    full = per_doc.join(needed, "query_id").where(F.col("met") == F.col("needed"))
    full = full.withColumn("score", F.round("score", 6))
    return top(full.select("query_id", "id", "score", F.round(1 / (1 + F.col("score")), 6).alias("shown")), k, F.col("score").desc(), F.col("id"))


def grep(docs: DataFrame, queries: DataFrame, name: Column, body: Column, k: int = 10, *, id_col: str = "doc_id", regex: bool = False) -> DataFrame:
    """Exact or prefix matches of the name score 1, substring or regular-expression matches of the body 0.8.

    All rows are looked at; nothing is cut off before ranking.
    """
    rows = docs.select(F.col(id_col).alias("id"), name.alias("name"), body.alias("body")).crossJoin(F.broadcast(queries.select("query_id", "pattern")))
    in_body = F.expr("body rlike concat('(?m)', pattern)") if regex else F.contains("body", F.col("pattern"))
    in_name = F.lit(False) if regex else F.startswith(F.lower("name"), F.lower("pattern"))
    scored = rows.withColumn("score", F.when(in_name, 1.0).when(in_body, 0.8)).where(F.col("score").isNotNull())
    return top(scored.select("query_id", "id", "score"), k, F.col("score").desc(), F.col("id"))


def sparse_dot(weights: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Dot product of sparse vectors: ``weights`` (id, token, weight), ``queries`` (query_id, token, weight)."""
    asked = queries.select("query_id", "token", F.col("weight").alias("asked"))
    hits = weights.join(asked, "token").groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * F.col("asked")), 6).alias("score"))
    return top(hits.where("score > 0"), k, F.col("score").desc(), F.col("id"))


def sparse_weights(docs: DataFrame, text: Column, *, id_col: str = "doc_id", most: int = 128) -> DataFrame:
    """The offline stand-in for a learned encoder: ln(1 + tf) of the ``most`` strongest terms."""
    counts = docs.select(F.col(id_col).alias("id"), F.explode(T.terms(text)).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    kept = counts.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("tf").desc(), "token"))).where(F.col("n") <= most)
    return kept.select("id", "token", F.round(F.log1p(F.col("tf")), 6).alias("weight"))


#: Candidates that a task of ``knn`` holds.
SHARD_ROWS = 16384


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", *, keep: Column | None = None) -> DataFrame:
    """Exact nearest vectors: ``vectors`` (id, v), ``queries`` (query_id, q); filters apply before ranking.

    ``l2`` scores max(0, 1 - d), ``l2_inverse`` 1 / (1 + d), ``cosine`` the cosine (zero vectors left out).
    Candidates are dealt into shards; a task holds one, and all queries stream past it in blocks.
    Only vectors of equal length are compared.  A shard gives k rows a query, ties to the smaller id.
    """
    rows = (vectors if keep is None else vectors.where(keep)).where("v IS NOT NULL AND size(v) > 0").select("id", F.col("v").cast("array<double>").alias("v"))
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), F.lit(0).alias("kind"), "id", "v")
    asked = queries.where("q IS NOT NULL").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("q").alias("dim"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), F.col("q").cast("array<double>").alias("v"))
    met = held.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "kind", "id")
    cosine = metric == "cosine"

    def best(ids: np.ndarray, points: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if cosine:
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.round((points @ q) / (np.sqrt((points * points).sum(1)) * np.sqrt(q @ q)), 6)
            fine = np.isfinite(value)
            ids, value = ids[fine], value[fine]
        else:
            value = np.round(np.sqrt(((points - q) ** 2).sum(1)), 6)
        order = np.lexsort((ids, -value if cosine else value))[:k]
        return ids[order], value[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, points = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("shard", "dim", "kind")])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])) if batch.num_rows else []
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                part, key = batch.slice(a, b - a), tuple(keys[:2, a])
                if key != here:
                    here, ids, points = key, [], []
                own = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                if keys[2, a] == 0:
                    ids.append(part.column("id").to_numpy())
                    points.append(own)
                elif ids:
                    ids, points = [np.concatenate(ids)], [np.concatenate(points)]
                    found = [best(ids[0], points[0], q) for q in own]
                    asks = np.repeat(part.column("id").to_numpy(), [len(x) for x, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(asks), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([v for _, v in found]))], ["query_id", "id", "value"])

    found = met.mapInArrow(run, "query_id bigint, id bigint, value double")
    if cosine:
        return top(found.select("query_id", "id", F.col("value").alias("score")), k, F.col("score").desc(), F.col("id"))
    score = F.greatest(F.lit(0.0), 1 - F.col("distance")) if metric == "l2" else 1 / (1 + F.col("distance"))
    return top(found.select("query_id", "id", F.col("value").alias("distance")).withColumn("score", F.round(score, 6)), k, F.col("distance"), F.col("id"))
