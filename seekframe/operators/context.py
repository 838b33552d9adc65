"""What a model is shown: preambles, groups of hits, prompts for files and hunks, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekframe.functions import text as T

# The kinds that a file's contents list.
TOP_LEVEL = ["module", "class", "interface", "function", "enum"]


def padded(value: Column, width: int) -> Column:
    """``value`` with blanks up to ``width``; nothing is cut."""
    return F.concat(value, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(value))))


def _digits(value: Column) -> Column:
    return value.cast("string")


def preamble(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, intent, preamble that tells a model what kind of code follows; empty for intents that need none.

    ``hits``: query_id, rank, rel_path, kind, name, qualified_name, line_start, line_end, no more of a query than its
    retrieval's k.  ``asked``: query_id, intent.  A query without hits has an empty preamble.
    """
    row = F.struct("rank", "rel_path", "kind", "name", "qualified_name", "line_start", "line_end")
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("h"))
    rows = asked.select("query_id", "intent").join(lists, "query_id", "left")
    paths = F.array_sort(F.array_distinct(F.transform("h", lambda x: x["rel_path"])))
    listed = F.transform(F.filter("h", lambda x: x["kind"].isin(TOP_LEVEL)), lambda x: F.concat(F.lit("#   "), padded(x["kind"], 12), F.lit(" "), padded(x["name"], 40), F.lit(" [lines "), _digits(x["line_start"]), F.lit("-"), _digits(x["line_end"]), F.lit("]")))
    file = F.concat_ws("\n", F.concat(F.lit("# File Overview: "), F.array_join(paths, ", ")), F.lit("# Contents:"), listed)
    more = F.when(F.size(paths) > 8, F.concat(F.lit("\n#   ... and "), _digits(F.size(paths) - 8), F.lit(" more"))).otherwise("")
    project = F.concat(F.lit("# Project Architecture Overview\n# Sources ("), _digits(F.size(paths)), F.lit(" files): "), F.array_join(F.slice(paths, 1, 8), ", "), more)
    first = F.get("h", F.lit(0))
    symbol = F.concat(F.lit("# Symbol: "), first["qualified_name"], F.lit(" ("), first["kind"], F.lit(") — "), first["rel_path"])
    by_intent = F.when(F.col("intent") == "file_overview", file).when(F.col("intent") == "project_overview", project).when(F.col("intent") == "comparison", F.lit("# Comparison")).when(F.col("intent") == "symbol_lookup", symbol)
    return rows.select("query_id", "intent", F.when(F.col("h").isNull(), "").otherwise(F.coalesce(by_intent, F.lit(""))).alias("preamble"))


def window_budget(model: Column, windows: Sequence[tuple[str, int]], fraction: float = 0.5, default: int = 12_000) -> Column:
    """The share of a model's window that its context may take; ``windows``: (prefix of the name, tokens), the first that fits holds."""
    found = F.lit(None).cast("long")
    for prefix, tokens in reversed(windows):
        found = F.when(F.startswith(F.lower(model), F.lit(prefix.lower())), F.lit(int(tokens * fraction))).otherwise(found)
    return F.coalesce(found, F.lit(default)).cast("long")


def map_groups(hits: DataFrame, size: int = 10, most_tokens: int = 8000, most_hits: int = 20) -> DataFrame:
    """query_id, grp (from 0), hits, context: the hits of queries that are too many for one answer, ``size`` at a time in their order.

    ``hits``: query_id, rank, rel_path, kind, name, body, tokens.
    """
    whole = Window.partitionBy("query_id")
    rows = hits.withColumn("n", F.row_number().over(whole.orderBy("rank"))).withColumn("all", F.count(F.lit(1)).over(whole)).withColumn("used", F.sum("tokens").over(whole))
    body = F.regexp_replace(F.col("body"), r"^\s+|\s+$", "")
    piece = F.concat(F.lit("# "), F.col("rel_path"), F.lit(" — "), F.col("name"), F.lit(" ("), F.col("kind"), F.lit(")\n"), body)
    rows = rows.where((F.col("used") > most_tokens) | (F.col("all") > most_hits)).select("query_id", F.floor((F.col("n") - 1) / size).alias("grp"), "n", piece.alias("piece"))
    out = rows.groupBy("query_id", "grp").agg(F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("p"))
    return out.select("query_id", "grp", "hits", F.array_join(F.transform("p", lambda x: x["piece"]), "\n\n").alias("context"))


def reduce_groups(answers: DataFrame) -> DataFrame:
    """query_id, partials: the non-blank answers to a query's groups, numbered anew; ``answers``: query_id, grp, answer."""
    kept = answers.withColumn("answer", F.regexp_replace("answer", r"^\s+|\s+$", "")).where("answer <> ''")
    lists = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("grp", "answer"))).alias("a"))
    return lists.select("query_id", F.array_join(F.transform("a", lambda x, i: F.concat(F.lit("[Partial "), (i + 1).cast("string"), F.lit("]\n"), x["answer"])), "\n\n").alias("partials"))


def _fenced(text: Column) -> Column:
    return F.concat(T.fence(text), F.lit("\n"), text, F.lit("\n"), T.fence(text))


def review_prompts(hunks: DataFrame, contexts: DataFrame, most: int = 3000) -> DataFrame:
    """id, hunk, prompt: what a reviewer is asked about each hunk; a hunk without a context is shown alone.

    ``hunks``: as ``diffs.hunks`` gives them.  ``contexts``: id, hunk, context, of which ``most`` characters are shown, as
    much as a reviewer's window leaves.  Fences are longer than any inside.
    """
    lines = lambda c, mark: F.when(F.col(c) != "", F.concat(F.lit(mark), F.regexp_replace(F.col(c), "\n", "\n" + mark)))
    shown = F.substring("context", 1, most)
    rows = hunks.join(contexts.select("id", "hunk", "context"), ["id", "hunk"], "left")
    head = F.concat(F.lit("File: "), F.col("file"), F.lit(" (lines "), _digits(F.col("new_start")), F.lit("–"), _digits(F.col("new_start") + F.col("new_count")), F.lit(")\n\n"))
    related = F.when(F.coalesce(shown, F.lit("")) != "", F.concat(F.lit("Related codebase context:\n"), _fenced(shown), F.lit("\n\n"))).otherwise("")
    changed = F.concat_ws("\n", lines("removed", "- "), lines("added", "+ "))
    return rows.select("id", "hunk", F.concat(head, F.lit("Changed code:\n"), _fenced(changed), F.lit("\n\n"), related, F.lit("Provide review comments as a JSON array.")).alias("prompt"))


def summary_prompts(symbols: DataFrame, files: DataFrame, most: int = 30, shown: int = 80) -> DataFrame:
    """file_id, prompt that asks for a file's summary by its first ``most`` symbols; files without symbols have none.

    ``symbols``: file_id, id, line, kind, qualified_name, signature.  ``files``: file_id, rel_path, language.
    """
    top = symbols.withColumn("n", F.row_number().over(Window.partitionBy("file_id").orderBy("line", "id"))).where(F.col("n") <= most)
    line = F.concat(F.lit("- "), F.col("kind"), F.lit(" "), F.col("qualified_name"), F.lit(": "), F.substring("signature", 1, shown))
    lists = top.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["line"]), "\n")
    prompt = F.concat(F.lit("File: "), F.col("rel_path"), F.lit("\nLanguage: "), F.col("language"), F.lit("\n\nTop symbols:\n"), text, F.lit("\n\nWrite a 2-4 sentence summary of what this file does."))
    return lists.join(files, "file_id").select("file_id", prompt.alias("prompt"))


def concept_batches(ranks: DataFrame, most: int = 200, size: int = 20) -> DataFrame:
    """id, batch (from 0), place (from 1): the ``most`` central symbols in batches that a model names concepts for; ``ranks``: id, rank."""
    first = ranks.orderBy(F.col("rank").desc(), "id").limit(most)
    rows = first.withColumn("place", F.row_number().over(Window.orderBy(F.col("rank").desc(), "id")).cast("long"))
    return rows.select("id", F.floor((F.col("place") - 1) / size).alias("batch"), "place")
