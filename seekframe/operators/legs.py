"""Legs that need no ranking model: direct paths, path seeds, summaries, parts of symbols, variants of a query, recorded scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekframe.operators import lookup, search


def listed_score(rank: Column) -> Column:
    """What is listed, not found, scores just below 1, in its order."""
    return F.round(1.0 - rank * 0.001, 6)


def file_overview(files: DataFrame, symbols: DataFrame, hints: DataFrame, per_hint: int = 2) -> DataFrame:
    """file_id, id, score, rank: all symbols, by line, of the ``per_hint`` shortest paths that have a hint in them.

    ``files``: file_id, rel_path.  ``symbols``: id, file_id, line.  ``hints``: hint.  A file named by several hints comes once.
    """
    met = files.join(hints, F.contains(F.lower("rel_path"), F.lower("hint")))
    order = Window.partitionBy("hint").orderBy(F.length("rel_path"), "rel_path", "file_id")
    chosen = met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_hint).select("file_id").distinct()
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("line", "id")).cast("long")
    return symbols.join(chosen, "file_id").select("file_id", "id", rank.alias("rank")).withColumn("score", listed_score(F.col("rank")))


# What tells most of a project, in this order; a path part that is none of its own code.
OVERVIEW = [r"(^|/)readme\.(md|rst|txt)$", r"\.md$", r"(package\.json|pyproject\.toml|cargo\.toml|go\.mod)$", r"(tsconfig\.json|setup\.py|setup\.cfg)$"]
NOT_OWN = r"(^|/)(node_modules|vendor)/"


def project_overview(files: DataFrame, symbols: DataFrame, most: int = 40) -> DataFrame:
    """id, priority, rank, score of the symbols that say what a project is: its readme, other documents, manifests, build files, modules.

    ``symbols``: id, file_id, kind, line.
    """
    path = F.lower("rel_path")
    priority = F.lit(None).cast("int")
    for i, pattern in reversed([*enumerate(OVERVIEW)]):
        priority = F.when(path.rlike(pattern) & ~path.rlike(NOT_OWN), i).otherwise(priority)
    rows = symbols.join(files, "file_id").withColumn("priority", F.coalesce(priority, F.when(F.col("kind") == "module", len(OVERVIEW))))
    order = ("priority", "rel_path", "line", "id")
    first = rows.where("priority IS NOT NULL").orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return first.select("id", "priority", "rank", listed_score(F.col("rank")).alias("score"))


def config_lookup(files: DataFrame, hints: DataFrame) -> DataFrame:
    """hint, file_id of the configuration files that a hint names; files that hold secrets are never among them."""
    return files.where(lookup.is_config(F.col("rel_path"))).join(hints, F.contains(F.lower("rel_path"), F.lower("hint"))).select("hint", "file_id")


def import_path_seed(imports: DataFrame, symbols: DataFrame, patterns: DataFrame, most: int = 30, per_file: int = 3) -> DataFrame:
    """id, grp, score, rank: the first symbols of the files (grp) whose imports are written with a pattern in them.

    ``imports``: grp, specifier.  ``patterns``: pattern.  ``symbols``: id, grp, kind, line.
    """
    files = imports.join(patterns, F.contains("specifier", F.col("pattern"))).select("grp").distinct()
    top = lookup.top_per_file(symbols.join(files, "grp", "left_semi"), per_file)
    first = top.orderBy("grp", "n").limit(most).withColumn("rank", F.row_number().over(Window.orderBy("grp", "n")).cast("long"))
    return first.select("id", "grp", F.lit(0.3).alias("score"), "rank")


def file_summaries(summaries: DataFrame, symbols: DataFrame, queries: DataFrame, k: int, metric: str = "l2_inverse") -> DataFrame:
    """query_id, file_id, id, score, rank: files by the vectors of their summaries, each shown by its first symbol.

    ``summaries``: file_id, v, text; one without a text, or whose file has no symbol, is left out after ranking.
    """
    found = search.knn(summaries.select(F.col("file_id").alias("id"), "v"), queries, k, metric).withColumnRenamed("id", "file_id")
    first = symbols.groupBy("file_id").agg(F.min(F.struct("line", "id")).alias("first"))
    shown = found.join(summaries.where("text <> ''").select("file_id"), "file_id").join(first, "file_id")
    return shown.select("query_id", "file_id", F.col("first.id").alias("id"), "score", "rank")


def sub_chunks(parts: DataFrame, queries: DataFrame, k: int, metric: str = "l2_inverse") -> DataFrame:
    """query_id, part_id, id, score, rank: parts of symbols by their own vectors, under the symbol's id; ``parts``: part_id, id, v."""
    found = search.knn(parts.select(F.col("part_id").alias("id"), "v"), queries, k, metric).withColumnRenamed("id", "part_id")
    return found.join(parts.select("part_id", "id"), "part_id").select("query_id", "part_id", "id", "score", "rank")


def variants(queries: DataFrame, expanded: DataFrame, most: int) -> DataFrame:
    """query_id, place, query: each query as asked (place 0), then the first ``most`` of its recorded variants, none twice, no blank one.

    ``queries``: query_id, query.  ``expanded``: query_id, place (from 1), query.
    """
    trimmed = expanded.select("query_id", "place", F.trim("query").alias("query")).where("query <> ''")
    kept = trimmed.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("n") <= most)
    rows = queries.select("query_id", F.lit(0).cast("long").alias("place"), "query").unionByName(kept.select("query_id", F.col("n").cast("long").alias("place"), "query"))
    return rows.groupBy("query_id", "query").agg(F.min("place").alias("place")).select("query_id", "place", "query")


def merge_variants(hits: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: what the variants of a query found, each id once with its best score, of equal ones that of the first variant.

    ``hits``: query_id, place, id, score, rank.
    """
    best = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy(F.col("score").desc(), "place", "rank"))).where("n = 1")
    return search.top(best.select("query_id", "id", "score", "place", F.col("rank").alias("was")), k, F.col("score").desc(), F.col("place"), F.col("was"), F.col("id")).select("query_id", "id", "score", "rank")


def rerank(hits: DataFrame, recorded: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank, outcome: hits by recorded scores (query_id, id, score); a query without any keeps its order.

    Hits without a score of their own come after those with one.
    """
    known = recorded.select("query_id", "id", F.col("score").alias("again"))
    asked = recorded.select("query_id").distinct().withColumn("has", F.lit(True))
    rows = hits.select("query_id", "id", "score", F.col("rank").alias("was")).join(known, ["query_id", "id"], "left").join(asked, "query_id", "left")
    rows = rows.select("query_id", "id", F.when(F.col("has"), F.col("again")).otherwise(F.col("score")).alias("score"), "was", F.when(F.col("has"), "reranked").otherwise("kept").alias("outcome"))
    order = (F.when(F.col("outcome") == "reranked", F.col("score")).desc_nulls_last(), F.col("was"), F.col("id"))
    return search.top(rows, k, *order).select("query_id", "id", "score", "rank", "outcome")


def by_path(found: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """query_id, place, recall_1, recall_5, recall_k, mrr, ndcg by the first hit whose path has the expected piece in it; place is -1 without one.

    ``found``: query_id, rank, rel_path.  ``expected``: query_id, piece.
    """
    first = found.join(expected, "query_id").where(F.contains("rel_path", F.col("piece"))).groupBy("query_id").agg(F.min("rank").alias("place"))
    place = F.col("place")
    within = lambda n: (place <= n).cast("double")
    rows = expected.select("query_id").join(first, "query_id", "left")
    measures = {"recall_1": within(1), "recall_5": within(5), "recall_k": within(k), "mrr": 1 / place, "ndcg": F.when(place <= k, 1 / F.log2(place + 1.0))}
    return rows.select("query_id", F.coalesce(place, F.lit(-1)).cast("long").alias("place"), *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name) for name, c in measures.items()])


def next_turn(turns: DataFrame) -> DataFrame:
    """session, turn: the number that a session's next turn gets; ``turns``: session, turn (null for one without turns)."""
    return turns.groupBy("session").agg((F.coalesce(F.max("turn"), F.lit(-1)) + 1).alias("turn"))


def settings_differ(one: DataFrame, other: DataFrame) -> DataFrame:
    """key, was, now of the settings (key, value) that two states do not share, those that only one has among them."""
    both = one.select("key", F.col("value").alias("was")).join(other.select("key", F.col("value").alias("now")), "key", "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))


def cross_repository(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """call_id, repo, id: unresolved calls (call_id, repo, name) that exactly one symbol (id, repo, name) of the other repositories answers."""
    met = calls.withColumnRenamed("repo", "own").join(symbols, "name").where("repo <> own")
    one = met.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("repo", "id")).alias("hit")).where("n = 1")
    return one.select("call_id", "hit.repo", "hit.id")
