"""Packing ranked chunks into a token budget.

Greedy packing skips what doesn't fit and goes on, so it is no prefix sum: it is a fold over
one query's ranked list.  A list is bounded by the retrieval's k, and the fold stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_flags(items: Column, budget: Column) -> Column:
    """For an array of structs with ``tokens``, in order: the positions (from 1) that are taken."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("taken"))

    def take(state: Column, item: Column) -> Column:
        at = state["at"] + 1
        fits = state["used"] + item["tokens"] <= budget
        return F.struct(
            F.when(fits, state["used"] + item["tokens"]).otherwise(state["used"]).cast("long").alias("used"),
            at.cast("long").alias("at"),
            F.when(fits, F.concat(state["taken"], F.array(at.cast("long")))).otherwise(state["taken"]).alias("taken"),
        )

    return F.aggregate(items, start, take, lambda s: s["taken"])


def _listed(hits: DataFrame, *by: str) -> DataFrame:
    return hits.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.col("tokens").cast("long").alias("tokens")))).alias("items"))


def greedy(hits: DataFrame, budget: int) -> DataFrame:
    """query_id, id, rank, tokens of what is taken; ``hits``: query_id, id, rank, tokens."""
    taken = _listed(hits, "query_id").withColumn("taken", greedy_flags(F.col("items"), F.lit(budget)))
    return taken.select("query_id", F.explode("taken").alias("at"), "items").select("query_id", F.element_at("items", F.col("at").cast("int")).alias("x")).select("query_id", "x.id", "x.rank", "x.tokens")


def proportional(hits: DataFrame, budget: int) -> DataFrame:
    """Each source first gets its share of the budget (half to even), then what is left over goes to the rest in order.

    ``hits``: query_id, source, id, rank, tokens.
    """
    per = hits.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("query_id", "source")))
    per = per.withColumn("slice", F.bround(F.lit(float(budget)) * F.col("m") / F.col("n"), 0).cast("long"))
    lists = per.groupBy("query_id", "source", "slice").agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.col("tokens").cast("long").alias("tokens")))).alias("items"))
    lists = lists.withColumn("taken", greedy_flags(F.col("items"), F.col("slice")))
    first = lists.select("query_id", "source", F.posexplode("items").alias("p", "x"), "taken").select("query_id", "source", "x.*", F.array_contains("taken", (F.col("p") + 1).cast("long")).alias("in"))
    used = first.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("in"), F.col("tokens"))), F.lit(0)).alias("used"))
    rest = _listed(first.where("not in"), "query_id").join(used, "query_id").withColumn("taken", greedy_flags(F.col("items"), F.lit(budget) - F.col("used")))
    second = rest.select("query_id", F.explode("taken").alias("at"), "items").select("query_id", F.element_at("items", F.col("at").cast("int")).alias("x")).select("query_id", "x.id", "x.rank", "x.tokens")
    return first.where("in").select("query_id", "id", "rank", "tokens").unionByName(second)


def breadth_first(hits: DataFrame, budget: int, per_group: int = 2) -> DataFrame:
    """Groups by their best hit, ``per_group`` hits of each, packed greedily in that order.

    ``hits``: query_id, grp, id, rank, score, tokens.
    """
    within = Window.partitionBy("query_id", "grp").orderBy(F.col("score").desc(), "rank")
    kept = hits.withColumn("i", F.row_number().over(within)).where(F.col("i") <= per_group)
    kept = kept.withColumn("best", F.max("score").over(Window.partitionBy("query_id", "grp"))).withColumn("first", F.min("rank").over(Window.partitionBy("query_id", "grp")))
    order = Window.partitionBy("query_id").orderBy(F.col("best").desc(), "first", "i")
    return greedy(kept.withColumn("rank", F.row_number().over(order).cast("long")).select("query_id", "id", "rank", "tokens"), budget)


def batches(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """by, id, batch: consecutive rows share a batch until the next would take it above ``most`` tokens.

    ``rows``: by, pos, id, tokens.  A row larger than ``most`` is a batch of its own.  A group is folded
    as a whole, so ``by`` has to bound it: a page of a file's chunks, not a repository.
    """
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "id", F.col("tokens").cast("long").alias("tokens")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("batch"), F.array().cast("array<bigint>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        over = (s["used"] > 0) & (s["used"] + x["tokens"] > most)
        batch = F.when(over, s["batch"] + 1).otherwise(s["batch"]).cast("long")
        return F.struct(F.when(over, x["tokens"]).otherwise(s["used"] + x["tokens"]).cast("long").alias("used"), batch.alias("batch"), F.concat(s["out"], F.array(batch)).alias("out"))

    lists = lists.withColumn("batch", F.aggregate("items", start, add, lambda s: s["out"]))
    return lists.select(*by, F.explode(F.arrays_zip("items", "batch")).alias("z")).select(*by, F.col("z.items.id").alias("id"), F.col("z.batch").alias("batch"))


def context(taken: DataFrame) -> DataFrame:
    """query_id and its context text: files in order of first appearance, their pieces by line.

    ``taken``: query_id, path, rank, line_start, line_end, name, body.
    """
    piece = F.concat(F.lit("[Lines "), F.col("line_start"), F.lit("-"), F.col("line_end"), F.lit("] "), F.col("name"), F.lit("\n"), F.col("body"))
    files = taken.groupBy("query_id", "path").agg(F.min("rank").alias("first"), F.array_sort(F.collect_list(F.struct("line_start", "rank", piece.alias("text")))).alias("parts"))
    text = F.concat(F.lit("=== "), F.col("path"), F.lit(" ===\n"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n"))
    whole = files.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("first", text.alias("text")))).alias("all"))
    return whole.select("query_id", F.array_join(F.transform("all", lambda f: f["text"]), "\n\n").alias("context"))


def history(turns: DataFrame, budget: int) -> DataFrame:
    """The latest turns of each conversation whose tokens fit; the last one always stays.

    ``turns``: conv, turn, tokens.
    """
    back = Window.partitionBy("conv").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").desc()))
    return turns.withColumn("so_far", F.sum("tokens").over(back)).withColumn("n", first).where((F.col("so_far") <= budget) | (F.col("n") == 1)).drop("n", "so_far")


def lexical_density(query: Column, segment: Column) -> Column:
    """Words shared with the query over the root of the segment's words and one; both are word sets."""
    return F.round(F.size(F.array_intersect(query, segment)) / F.sqrt(F.size(segment) + 1.0), 6)


def segments(text: Column) -> Column:
    """Runs of lines between blank ones."""
    return F.filter(F.split(text, r"\n[ \t]*\n+"), lambda s: F.trim(s) != "")


def compress(units: DataFrame, query: Column, ratio: float) -> DataFrame:
    """id, kept (segments by density until ``ratio`` of the words are used, the first always), text with elision marks.

    ``units``: id, text.
    """
    from seekframe.functions.text import word_set, words

    parts = units.select("id", words(F.col("text")).alias("total"), F.posexplode(segments(F.col("text"))).alias("pos", "part"))
    parts = parts.select("id", "total", F.col("pos").cast("long").alias("pos"), "part", words(F.col("part")).alias("tokens"), lexical_density(query, word_set(F.col("part"))).alias("density"))
    order = Window.partitionBy("id").orderBy((F.col("pos") == 0).desc(), F.col("density").desc(), "pos")
    ranked = parts.withColumn("rank", F.row_number().over(order).cast("long"))
    lists = ranked.groupBy("id", "total").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "tokens", "part"))).alias("items"))
    target = F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") * ratio).cast("long"))
    taken = F.array_union(greedy_flags(F.col("items"), target), F.array(F.lit(1).cast("long")))
    parts = lists.select("id", F.array_sort(F.transform(taken, lambda i: F.element_at(F.col("items"), i.cast("int")).dropFields("rank", "tokens"))).alias("parts"))

    def shown(part: Column, i: Column) -> Column:
        before = F.get(F.col("parts"), i - 1)["pos"]
        return F.when((i > 0) & (before + 1 < part["pos"]), F.concat(F.lit("# ...\n"), part["part"])).otherwise(part["part"])

    return parts.select("id", F.size("parts").cast("long").alias("kept"), F.array_join(F.transform("parts", shown), "\n\n").alias("text"))
