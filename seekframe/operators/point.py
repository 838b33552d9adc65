"""Point reads and small writes on an index's tables: imports, chunks, references, flows, settings, contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekframe.operators.lookup import rank_of


def files_importing(imports: DataFrame, pattern: str) -> DataFrame:
    """file_id of the files (imports: file_id, specifier) that write an import with the pattern in it; null specifiers match nothing."""
    return imports.where(F.contains("specifier", F.lit(pattern))).select("file_id").distinct()


def chunks_of_files(chunks: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, chunk_id of the chunks (chunk_id, symbol_id) of all symbols (id, file_id) in ``files`` (file_id)."""
    of = symbols.join(files.select("file_id"), "file_id", "left_semi").select(F.col("id").alias("symbol_id"), "file_id")
    return chunks.join(of, "symbol_id").select("file_id", "chunk_id")


def chunks_of_names(chunks: DataFrame, symbols: DataFrame, names: DataFrame) -> DataFrame:
    """file_id, qualified_name, chunk_id of the chunks of the symbols that ``names`` (file_id, qualified_name) tell."""
    of = symbols.join(names.select("file_id", "qualified_name").distinct(), ["file_id", "qualified_name"]).select(F.col("id").alias("symbol_id"), "file_id", "qualified_name")
    return chunks.join(of, "symbol_id").select("file_id", "qualified_name", "chunk_id")


def chunk_texts(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "text", "tokens")


def targets(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, refs: what each of the symbols (id) refers to outside the code, in order, an empty list if nothing; ``edges``: id, source_ref."""
    refs = edges.join(symbols, "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("source_ref")).alias("refs"))
    return symbols.select("id").join(refs, "id", "left").select("id", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))


def artifacts_by_ref(artifacts: DataFrame, refs: DataFrame) -> DataFrame:
    """ref and the artifact of that source_ref, nulls where there is none."""
    return refs.select("ref").join(artifacts.withColumnRenamed("source_ref", "ref"), "ref", "left")


def flows(def_use: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol_id, n, var_name, def_line, use_line, edge_type: the flows within each of the symbols (symbol_id) by the line of the definition."""
    order = Window.partitionBy("symbol_id").orderBy("def_line", "use_line", "var_name", "edge_type")
    own = def_use.join(symbols.select("symbol_id"), "symbol_id", "left_semi")
    return own.withColumn("n", F.row_number().over(order).cast("long")).select("symbol_id", "n", "var_name", "def_line", "use_line", "edge_type")


def taint(findings: DataFrame, severity: str | None = None, most: int = 50) -> DataFrame:
    """The first ``most`` findings, severities in descending order of their names, or those of one severity."""
    kept = findings if severity is None else findings.where(F.col("severity") == severity)
    return kept.orderBy(F.col("severity").desc(), "source_file", "source_line", "sink_file", "sink_line", "rule_id").limit(most)


def settings_after(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """key, value after ``changes`` (seq, key, value), of which the last one of a key holds; a null value deletes the key."""
    rows = settings.select("key", "value", F.lit(None).cast("long").alias("seq")).unionByName(changes.select("key", "value", F.col("seq").cast("long").alias("seq")))
    last = rows.groupBy("key").agg(F.max(F.struct(F.coalesce("seq", F.lit(-(1 << 62))).alias("seq"), "value")).alias("last"))
    return last.select("key", F.col("last.value").alias("value")).where("value IS NOT NULL")


def settings_under(settings: DataFrame, prefix: str) -> DataFrame:
    return settings.where(F.startswith("key", F.lit(prefix))).select("key", "value")


def contents(symbols: DataFrame, kinds: Sequence[str] = ("module", "class", "interface", "function", "method")) -> DataFrame:
    """grp, n, id, kind: all symbols of each file (grp) by kind, then line."""
    order = Window.partitionBy("grp").orderBy(rank_of(F.col("kind"), kinds), "line", "id")
    return symbols.select("grp", F.row_number().over(order).cast("long").alias("n"), "id", "kind")


def changed(events: DataFrame, *by: str) -> DataFrame:
    """Events (by, ts, seq, hash) whose content is not that of the event before on the same path; nulls are contents of their own."""
    order = Window.partitionBy(*by).orderBy("ts", "seq")
    first: Column = F.row_number().over(order) == 1
    same = F.col("hash").eqNullSafe(F.lag("hash").over(order))
    return events.withColumn("keep", first | ~same).where("keep").drop("keep")
