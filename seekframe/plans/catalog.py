"""The registered queries of the retrieval engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seekframe.plans import assembly, context, graphs, legs, lookups, retrieval, streams, upkeep

hybrid_search = retrieval.hybrid_search
_ALL = {**retrieval.QUERIES, **graphs.QUERIES, **upkeep.QUERIES, **assembly.QUERIES, **lookups.QUERIES, **legs.QUERIES, **context.QUERIES, **streams.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
