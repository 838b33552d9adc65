"""Point lookups and ordered listings of symbols and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# File names and extensions of configuration, and those that hold secrets and are never shown.
CONFIG_NAMES = ["dockerfile", "containerfile", "makefile", "procfile", "setup.cfg", "nginx.conf", "package.json", "pyproject.toml"]
CONFIG_EXTENSIONS = ["json", "yaml", "yml", "toml", "ini", "cfg", "conf", "tf"]
SECRET_NAMES = [".env", ".envrc", ".npmrc", ".netrc", ".pgpass", "kubeconfig"]
SECRET_EXTENSIONS = ["env", "tfvars", "pem", "key", "p12", "pfx", "keystore"]


def rank_of(value: Column, order: Sequence[str]) -> Column:
    """The place of a value in ``order``, what is not in it last."""
    out = F.lit(len(order))
    for i, v in reversed([*enumerate(order)]):
        out = F.when(value == v, i).otherwise(out)
    return out


def by_name(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """asked, id of the symbols whose name or qualified name is asked for; two equality joins instead of one with ``or``."""
    asked = names.select("asked")
    plain = symbols.join(asked, F.col("name") == F.col("asked")).select("asked", "id")
    return plain.unionByName(symbols.join(asked, F.col("qualified_name") == F.col("asked")).select("asked", "id")).distinct()


def top_per_file(symbols: DataFrame, k: int, kinds: Sequence[str] = ("class", "function", "method")) -> DataFrame:
    order = Window.partitionBy("grp").orderBy(rank_of(F.col("kind"), kinds), "line", "id")
    return symbols.withColumn("n", F.row_number().over(order).cast("bigint")).where(F.col("n") <= k)


def path_fragment(files: DataFrame, fragment: str) -> DataFrame:
    """Files whose path has the fragment in any case, shortest first."""
    return files.where(F.contains(F.lower("rel_path"), F.lit(fragment.lower()))).select("file_id", "rel_path", F.length("rel_path").cast("bigint").alias("length")).orderBy("length", "rel_path")


def hydrate(hits: DataFrame, chunks: DataFrame, symbols: DataFrame, most: int = 2000) -> DataFrame:
    """Hits (symbol_id) with their symbol's first chunk; without one the start of the body and no tokens."""
    first = chunks.groupBy("symbol_id").agg(F.min_by(F.struct("text", "tokens"), "chunk_id").alias("c"))
    rows = hits.join(symbols.select(F.col("id").alias("symbol_id"), "name", "body"), "symbol_id").join(first, "symbol_id", "left")
    return rows.select("symbol_id", "name", F.coalesce("c.text", F.substring("body", 1, most)).alias("text"), F.coalesce("c.tokens", F.lit(0)).cast("bigint").alias("tokens"))


def is_config(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    extension = F.regexp_extract(name, r"\.([^.]+)$", 1)
    secret = name.isin(SECRET_NAMES) | extension.isin(SECRET_EXTENSIONS)
    known = name.isin(CONFIG_NAMES) | extension.isin(CONFIG_EXTENSIONS) | F.substring_index(name, ".", 1).isin(CONFIG_NAMES) | F.contains(name, F.lit("config"))
    return ~secret & known


def same_community(communities: DataFrame, nodes: DataFrame) -> DataFrame:
    """id of all nodes that share a community with one of ``nodes`` (id)."""
    own = communities.join(nodes, "id", "left_semi").select("community").distinct()
    return communities.join(own, "community", "left_semi").select("id", "community")


def latest_before(rows: DataFrame, by: str, order: Sequence[str], value: Column) -> DataFrame:
    """``rows`` with ``latest``: the last non-null value up to each row."""
    frame = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("latest", F.last(value, ignorenulls=True).over(frame))
