"""Retrieval and synthesis metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg, recall, mrr per query of ``relevant`` (query_id, id); ``found``: query_id, id, rank (from 1).

    A repeated id counts at its first rank only, and later ids move up; no relevant id gives 0.
    """
    first = found.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")))
    hits = first.join(relevant.distinct(), ["query_id", "id"])
    gained = hits.groupBy("query_id").agg(
        F.sum(F.when(F.col("place") <= k, 1 / F.log2(F.col("place") + 1.0))).alias("gain"),
        F.count(F.when(F.col("place") <= k, 1)).alias("met"),
        F.min("place").alias("first"),
    )
    size = relevant.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("size"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = size.join(gained, "query_id", "left")
    return out.select(
        "query_id",
        F.round(F.coalesce(F.col("gain"), F.lit(0.0)) / ideal, 6).alias("ndcg"),
        F.round(F.coalesce("met", F.lit(0)) / F.col("size"), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
    )


def means(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in per_query.columns if c != "query_id"])


def synthesis(answers: DataFrame) -> DataFrame:
    """query_id, hallucination, completeness, faithfulness, overall.

    ``answers``: query_id, answer, expected (array), fragments (array), retrieved (array), context.
    """
    answer, context = F.lower("answer"), F.lower("context")
    inside = lambda x: F.contains(answer, F.lower(x))
    made_up = F.size(F.filter("expected", lambda s: inside(s) & ~F.array_contains("retrieved", s)))
    hallucination = F.when(F.size("expected") > 0, made_up / F.size("expected")).otherwise(0.0)
    found = F.size(F.filter("fragments", inside))
    completeness = F.when(F.size("fragments") > 0, found / F.size("fragments")).otherwise(1.0)
    words = F.regexp_extract_all(answer, F.lit("[a-z0-9_]{4,}"), F.lit(0))
    grounded = F.size(F.filter(words, lambda w: F.contains(context, w)))
    faithfulness = F.when(F.size(words) > 0, grounded / F.size(words)).otherwise(0.0)
    parts = answers.select("query_id", hallucination.alias("h"), completeness.alias("c"), faithfulness.alias("f"))
    return parts.select(
        "query_id",
        F.round("h", 6).alias("hallucination"),
        F.round("c", 6).alias("completeness"),
        F.round("f", 6).alias("faithfulness"),
        F.round(0.4 * (1 - F.col("h")) + 0.4 * F.col("c") + 0.2 * F.col("f"), 6).alias("overall"),
    )


def latency(samples: DataFrame, value: Column, *by: str) -> DataFrame:
    """by, n, p50, p95: the values at places n // 2 and int(0.95 n) of the sorted samples, counted from 0.

    Equal values are counted before they are sorted, so a group costs its distinct values.
    """
    counts = samples.select(*by, value.alias("v")).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("v"))).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    return upto.groupBy(*by).agg(F.max("all").alias("n"), at(F.floor(F.col("all") / 2)).alias("p50"), at(F.floor(F.col("all") * 0.95)).alias("p95"))
