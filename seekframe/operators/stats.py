"""Counts over a corpus, and thinning out of event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corpus(docs: DataFrame, by: str, group: str, size: Column) -> DataFrame:
    return docs.groupBy(by).agg(F.count(F.lit(1)).alias("docs"), F.countDistinct(group).alias("sources"), F.sum(size).cast("bigint").alias("chars"))


def top_groups(rows: DataFrame, by: str, group: str, k: int) -> DataFrame:
    """by, group, n, rank of the ``k`` commonest groups."""
    counts = rows.groupBy(by, group).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col("n").desc(), group)).cast("bigint"))
    return ranked.where(F.col("rank") <= k)


def top_directories(files: DataFrame, few: int = 2, most: int = 12) -> DataFrame:
    """The first ``most`` top-level directories in order; with ``few`` or fewer of them, those one level down."""
    parts = F.split("path", "/")
    dirs = files.where(F.size(parts) > 1).select(parts[0].alias("a"), F.when(F.size(parts) > 2, F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0]).alias("b")).distinct()
    n = dirs.agg(F.countDistinct("a").alias("n"))
    return dirs.crossJoin(F.broadcast(n)).select(F.when(F.col("n") <= few, F.col("b")).otherwise(F.col("a")).alias("dir")).distinct().orderBy("dir").limit(most)


def left_counts(parents: DataFrame, children: DataFrame) -> DataFrame:
    """id, n: children of each parent, none too.  Children are counted before they are joined."""
    counts = children.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return parents.join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def debounce(events: DataFrame, by: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """The last event of each run whose gaps are no longer than ``seconds``."""
    order = Window.partitionBy(by).orderBy(ts, tie)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = F.unix_micros(F.lead(ts).over(order).cast("timestamp")) - us
    return events.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > seconds * 1_000_000)).drop("_gap", ts)
