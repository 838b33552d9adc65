"""Fusing ranked lists and what follows: reciprocal ranks, duplicates, boosts, floors, multi-vector scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How much a hit counts by the language of its file; others count 1, unknown ones 0.8.
LANGUAGE_WEIGHTS = {"html": 0.4, "css": 0.4, "json": 0.5, "yaml": 0.5, "toml": 0.5, "markdown": 0.3, "unknown": 0.8}


def weight_of(key: Column, weights: Mapping[str, float], default: float = 1.0) -> Column:
    if not weights:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def lists(*legs: tuple[str, DataFrame]) -> DataFrame:
    """query_id, list_idx, source, pos, id, score of all legs, in the order given."""
    parts = [d.select("query_id", F.lit(i).cast("long").alias("list_idx"), F.lit(s).alias("source"), F.col("rank").cast("long").alias("pos"), "id", F.col("score").cast("double").alias("score")) for i, (s, d) in enumerate(legs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rrf(hits: DataFrame, k: int = 60, *, leg_weights: Mapping[str, float] | None = None, language: Column | None = None, language_weights: Mapping[str, float] | None = None, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: every place of an id in a list adds weight / (k + place); the first place seen gives the source.

    Order: score, then first seen.  ``language`` must be a function of the id.
    """
    weight = weight_of(F.col("source"), leg_weights or {})
    lang = weight_of(language, language_weights if language_weights is not None else LANGUAGE_WEIGHTS) if language is not None else F.lit(1.0)
    fused = hits.groupBy("query_id", "id").agg(F.sum(weight / (k + F.col("pos"))).alias("raw"), F.max(lang).alias("lang_weight"), F.min(F.struct("list_idx", "pos", "source")).alias("first"))
    fused = fused.select("query_id", "id", F.round(F.col("raw") * F.col("lang_weight"), 9).alias("score"), F.col("first.source").alias("source"), F.col("first.list_idx").alias("list_idx"), F.col("first.pos").alias("pos"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "list_idx", "pos", "id")
    ranked = fused.withColumn("rank", F.row_number().over(order).cast("long"))
    return (ranked if limit is None else ranked.where(F.col("rank") <= limit)).select("query_id", "id", "score", "source", "rank")


def federated(hits: DataFrame, registry: DataFrame, leg: str, *, limit: int | None = None) -> DataFrame:
    """One leg's hits of several repositories, each a list of its own, fused by the weights of the registry.

    ``hits``: query_id, id, rank, score, alias.  ``registry``: alias, list_idx, weight; a repository that is not in it has no say.
    """
    known = hits.join(registry, "alias")
    weights = {f"{r['alias']}:{leg}": r["weight"] for r in registry.collect()}  # a row for each repository
    rows = known.select("query_id", "list_idx", F.concat("alias", F.lit(f":{leg}")).alias("source"), F.col("rank").cast("long").alias("pos"), "id", F.col("score").cast("double").alias("score"))
    return rrf(rows, leg_weights=weights, limit=limit)


def dedup_best(hits: DataFrame) -> DataFrame:
    """One row per query and id, that of the best score; of equal ones the first."""
    order = Window.partitionBy("query_id", "id").orderBy(F.col("score").desc(), "list_idx", "pos")
    return hits.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def boost(hits: DataFrame, central: DataFrame, factor: float = 1.3, head: int = 200) -> DataFrame:
    """Hits among the ``head`` most central nodes (id, centrality) count ``factor`` times."""
    best = central.orderBy(F.col("centrality").desc(), "id").limit(head).select("id", F.lit(True).alias("is_central"))
    joined = hits.join(best, "id", "left").withColumn("score", F.round(F.when(F.col("is_central"), F.col("score") * factor).otherwise(F.col("score")), 9))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank", "id")
    return joined.select("query_id", "id", "score", F.row_number().over(order).cast("long").alias("rank"))


def breadth_floor(hits: DataFrame, fallback: DataFrame, group: str, least_groups: int = 2, least_hits: int = 10) -> DataFrame:
    """Queries with few groups and few hits also get what is new among ``fallback``, after their own."""
    size = hits.groupBy("query_id").agg(F.countDistinct(group).alias("groups"), F.count(F.lit(1)).alias("n"))
    narrow = fallback.join(size, "query_id", "left").where(F.coalesce(F.col("groups") < least_groups, F.lit(True)) & F.coalesce(F.col("n") < least_hits, F.lit(True))).drop("groups", "n")
    new = narrow.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return hits.withColumn("extra", F.lit(False)).unionByName(new.withColumn("extra", F.lit(True)))


def xtr(scores: DataFrame, query_tokens: DataFrame, impute: float) -> DataFrame:
    """Per document the mean over query tokens of its best score for the token, ``impute`` where it has none.

    ``scores``: query_id, token, id, score.  ``query_tokens``: query_id, token.  Scores are added as decimals of twelve places,
    so the order of addition, which differs from run to run, shows in no digit.
    """
    n = query_tokens.groupBy("query_id").agg(F.count(F.lit(1)).alias("tokens"))
    best = scores.groupBy("query_id", "id", "token").agg(F.max("score").alias("best"))
    found = best.groupBy("query_id", "id").agg(F.sum(F.col("best").cast("decimal(24,12)")).alias("total"), F.count(F.lit(1)).alias("met"))
    missing = (F.col("tokens") - F.col("met")).cast("decimal(12,0)") * F.lit(impute).cast("decimal(24,12)")
    mean = (F.col("total") + missing) / F.col("tokens").cast("decimal(12,0)")
    return found.join(n, "query_id").select("query_id", "id", F.round(mean, 6).cast("double").alias("score"))


def page(ranked: DataFrame, cursor: int, size: int) -> DataFrame:
    """Rows cursor+1 to cursor+size of each query's order, and the next cursor (null at the end)."""
    total = F.max("rank").over(Window.partitionBy("query_id"))
    shown = ranked.withColumn("total", total).where((F.col("rank") > cursor) & (F.col("rank") <= cursor + size))
    return shown.withColumn("next_cursor", F.when(F.col("total") > cursor + size, F.lit(cursor + size).cast("long"))).drop("total")
