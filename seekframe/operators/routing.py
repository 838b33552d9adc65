"""Routing queries: a tier, whether only words are searched, and the plan that an intent names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.functions import text as T

# What a plan does for each intent.
# intent, call depth, legs, skip reranking, import depth, extra files, direction, assembly, rerank head, compression
STRATEGIES = [
    ("symbol_lookup", 1, "grep,bm25,vector", False, 1, 3, "both", "greedy", 20, 1.0),
    ("file_overview", 0, "file_direct", True, 0, 0, "both", "greedy", 20, 1.0),
    ("feature_flow", 2, "vector,bm25", False, 2, 15, "both", "greedy", 30, 0.45),
    ("project_overview", 0, "file_direct", True, 0, 0, "both", "greedy", 20, 1.0),
    ("comparison", 1, "vector,bm25,grep", False, 1, 8, "both", "greedy", 35, 0.65),
    ("config_lookup", 0, "file_direct,grep", True, 0, 0, "both", "greedy", 20, 1.0),
    ("dependency_map", 1, "vector,bm25", False, 2, 20, "forward", "breadth_first", 30, 0.3),
    ("blast_radius", 0, "grep,vector,bm25", False, 1, 30, "reverse", "breadth_first", 40, 0.3),
]
SCHEMA = "intent string, expand_depth int, legs string, skip_reranker boolean, import_depth int, import_max_extra int, import_direction string, assembly string, rerank_top_n int, compression_ratio double"

# Questions answered without search, and signs of several questions in one.
TRIVIAL = [r"(?i)^what (is|are) \w+\??$", r"(?i)^(list|show) all ", r"(?i)^define "]
SEVERAL = ["from ... to ...", "end-to-end", "step by step", "walk me through", "full flow"]


def strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STRATEGIES, SCHEMA)


def tier(query: Column) -> Column:
    trivial = F.lit(False)
    for p in TRIVIAL:
        trivial = trivial | F.trim(query).rlike(p)
    several = T.any_of(query, SEVERAL) | ((F.length(query) > 80) & (F.regexp_count(F.lower(query), F.lit(" and ")) >= 2))
    return F.when(trivial, 1).when(several, 3).otherwise(2).cast("long")


def route(queries: DataFrame, short: int = 5) -> DataFrame:
    """query_id, tier, tokens, lexical_only; ``queries``: query_id, query."""
    q = F.col("query")
    return queries.select("query_id", tier(q).alias("tier"), T.meaningful_tokens(q).alias("tokens"), (T.meaningful_tokens(q) <= short).alias("lexical_only"))


def planned(queries: DataFrame, default: str = "symbol_lookup") -> DataFrame:
    """Each query with the strategy of its intent hint, or of ``default``; ``queries``: query_id, intent."""
    known = strategies(queries.sparkSession)
    hinted = queries.join(F.broadcast(known.select("intent")), "intent", "left_semi").unionByName(queries.join(F.broadcast(known.select("intent")), "intent", "left_anti").withColumn("intent", F.lit(default)))
    return hinted.join(F.broadcast(known), "intent")
