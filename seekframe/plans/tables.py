"""How the entities of the engine are bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call graph: within an order each part leads to the next line's part."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(line).alias("b"))
    lines = lines.where(F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    return lines.select(F.concat(F.lit("p:"), "a").alias("src"), F.concat(F.lit("p:"), "b").alias("dst"))


EDGES = """e AS (
  SELECT 'p:' || a AS src, 'p:' || b AS dst FROM (
    SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b FROM lineitem)
  WHERE b IS NOT NULL AND a <> b
), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"""


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("class", "function", "method", "interface")]), (F.col("p_size") % 4 + 1).cast("int"))
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), (F.col("p_partkey") % 97).cast("string")).alias("name"),
        F.concat(F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("."), F.regexp_replace("p_name", " ", "_"), F.lit("_"), (F.col("p_partkey") % 97).cast("string")).alias("qualified_name"),
        kinds.alias("kind"),
        F.col("p_type").alias("grp"),
    )


SYMBOLS = """sym AS (
  SELECT p_partkey AS id, replace(p_name, ' ', '_') || '_' || (p_partkey % 97) AS name,
         lower(replace(p_brand, '#', '')) || '.' || replace(p_name, ' ', '_') || '_' || (p_partkey % 97) AS qualified_name,
         ['class', 'function', 'method', 'interface'][p_size % 4 + 1] AS kind, p_type AS grp FROM part)"""
