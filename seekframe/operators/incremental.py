"""Keeping an index in step with its source: drift, prune plans, coverage, upserts, cascades."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drift(disk: DataFrame, index: DataFrame) -> DataFrame:
    """path, state (new, stale, unchanged, missing); both sides: path, hash."""
    both = disk.select("path", F.col("hash").alias("now")).join(index.select("path", F.col("hash").alias("was"), F.lit(True).alias("known")), "path", "full_outer")
    gone = F.col("now").isNull()
    state = F.when(gone, "missing").when(F.col("was").isNull(), "new").when(F.col("now") != F.col("was"), "stale").otherwise("unchanged")
    return both.select("path", state.alias("state"))


def drift_report(states: DataFrame) -> DataFrame:
    """One row of counts."""
    return states.agg(*[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("new", "stale", "unchanged", "missing")])


def prune_plan(states: DataFrame, trusted: bool = True, least: int = 10, share: float = 0.1) -> DataFrame:
    """How many entries to prune, of how many, and whether to refuse: an untrusted walk, or both many and a large share."""
    counts = states.agg(F.count(F.when(F.col("state") == "missing", 1)).alias("candidates"), F.count(F.when(F.col("state") != "new", 1)).alias("indexed"))
    fraction = F.round(F.when(F.col("indexed") > 0, F.col("candidates") / F.col("indexed")).otherwise(0.0), 6)
    counts = counts.withColumn("fraction", fraction)
    reason = F.when(F.lit(not trusted), "untrusted_walk").when((F.col("candidates") > least) & (F.col("fraction") > share), "too_many")
    return counts.withColumn("refused", F.coalesce(reason, F.lit("")))


def without(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` that ``right`` lacks: chunks without vectors, vectors without chunks."""
    return left.join(right.select(*on), [*on], "left_anti")


def coverage(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks with a vector, without one, and vectors that belong to no chunk; both sides: id."""
    both = chunks.select("id", F.lit(True).alias("c")).join(vectors.select("id", F.lit(True).alias("v")), "id", "full_outer")
    return both.agg(
        F.count(F.when(F.col("c") & F.col("v"), 1)).alias("with_vector"),
        F.count(F.when(F.col("c") & F.col("v").isNull(), 1)).alias("without_vector"),
        F.count(F.when(F.col("c").isNull(), 1)).alias("orphaned"),
    )


def upsert(table: DataFrame, changes: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """``table`` and ``changes`` with the latest version of each key."""
    rows = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(*key).orderBy(F.col(version).desc(), F.col("_new").desc())
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_new")


def diff(old: DataFrame, new: DataFrame, key: Sequence[str], content: str) -> DataFrame:
    """key, change (added, removed, changed, same) by comparing content hashes."""
    both = old.select(*key, F.col(content).alias("was")).join(new.select(*key, F.col(content).alias("now")), [*key], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return both.select(*key, change.alias("change"))


def cascade_delete(gone: DataFrame, children: Mapping[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """What is left of each child table (table, its column that names the parent) without rows of ``gone`` (id)."""
    return {name: table.join(gone.select(F.col("id").alias(column)), column, "left_anti") for name, (table, column) in children.items()}


def vector_width(vectors: DataFrame, expected: int) -> DataFrame:
    """The widths of stored vectors and whether each is the expected one."""
    return vectors.groupBy(F.size("v").cast("long").alias("width")).agg(F.count(F.lit(1)).alias("n")).withColumn("fits", F.col("width") == expected)


def cost(chunks: DataFrame, price_per_million: float) -> DataFrame:
    """Chunks, tokens and price of embedding them; ``chunks``: tokens."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens")).withColumn("cost", F.round(F.col("tokens") * F.lit(price_per_million) / 1e6, 6))


def latest_sessions(turns: DataFrame, now, max_age_s: int) -> tuple[DataFrame, DataFrame]:
    """Sessions (session, last) that stay, and those idle for longer than ``max_age_s``."""
    last = turns.groupBy("session").agg(F.max("ts").alias("last"))
    idle = F.unix_timestamp(F.lit(now).cast("timestamp_ntz").cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp")) > max_age_s
    return last.where(~idle), last.where(idle)
