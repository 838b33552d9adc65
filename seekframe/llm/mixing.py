"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 2).

Every source gets a share of all words by its weight; no share may exceed
``most_epochs`` times the source's own words, and what is cut off is shared again by
weight among the others.  Whole epochs of a source come first.  What is left of its
target is filled from documents ordered by an exponential key divided by the document's
quality weight (the order of a weighted sample without replacement): sizes are summed in
that order, and the document in which the budget ends is taken in part.

The running sums need no task that sees a whole source: keys are dealt into buckets of
about ``BUCKET_ROWS`` rows, bucket totals are summed per source, and rows are ordered
within their bucket only.

Results: a null text has size 0 and is taken 0 words.  A null source is a source of its
own, last in order.  The draw depends on the id and the text alone, so reruns agree and
the order of rows does not matter; equal keys are ordered by id, then text; of wholly
equal rows any may come first.  An empty table gives an empty result.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekframe.llm.runtime import materialise

BUCKET_ROWS = 500
#: The bits of a digest that make a uniform number.
DRAW_HEX = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(chars: Column, size: Column) -> Column:
    """1 for texts whose mean word has 3 to 12 characters, blanks counted, and a half for others."""
    mean = chars / F.greatest(size, F.lit(1))
    return F.when(mean.between(3, 12), 1.0).otherwise(0.5)


def draw(id_col: Column, text_md5: Column, seed: int) -> Column:
    """A uniform number in (0, 1) from a digest of the id and the text."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit("|"), text_md5))
    return (F.conv(F.substring(digest, 1, DRAW_HEX), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DRAW_HEX))


def targets(sizes: DataFrame, source_col: str, weights: Sequence[float], most_epochs: int) -> DataFrame:
    """Per source its words, target, whole epochs and the words left for sampling; one row per source."""
    everything = Window.partitionBy()
    ordered = Window.partitionBy().orderBy(F.col(source_col).asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_ratio = Window.partitionBy().orderBy("ratio", F.col(source_col).asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    shares = (
        sizes.withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("cap", F.col("source_size") * most_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_from", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("ratio") <= (F.col("total") - F.col("cap_before")) / F.col("weight_from"))
    )
    free = Window.partitionBy()
    spare = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(free), F.lit(0))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * spare / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(free))
    return (
        shares.withColumn("target", target)
        .withColumn("epochs", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long"))
        .withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + F.lit(0.5)).cast("long"))
        .select(F.col(source_col).alias("_source"), "source_size", "n_docs", "target", "epochs", "budget")
    )


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most_epochs: int = 3, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, seed: int = 11) -> DataFrame:
    """Per document what the mix takes of it.

    Columns: the id, ``text_md5``, ``size``, ``source_size``, ``target``, ``copies`` (whole
    times it is taken) and ``taken`` (words, a part of the last copy included).
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        F.md5(F.coalesce(text, F.lit(""))).alias("text_md5"),
        word_count(text).alias("size"),
        F.length(text).alias("chars"),
        (quality if quality is not None else F.lit(None)).cast("double").alias("weight"),
    )
    weight = F.coalesce(F.col("weight"), quality_weight(F.col("chars"), F.col("size")))
    rows = rows.select("_id", "_source", "text_md5", "size", (-F.ln(draw(F.col("_id"), F.col("text_md5"), seed)) / weight).alias("key"))
    rows = materialise(rows, "mix-rows")
    sizes = rows.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rows = _with_plan(rows, materialise(targets(sizes, "_source", weights, most_epochs), "mix-targets"))
    parts = F.ceil(F.col("n_docs") / BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * parts), parts - 1).cast("long"))
    buckets = rows.groupBy("_tag", "bucket").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("_tag").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("_tag", "bucket", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("words_before"))
    inner = Window.partitionBy("_tag", "bucket").orderBy("key", "_id", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("words_before") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - start))
    return (
        rows.join(buckets, ["_tag", "bucket"])
        .withColumn("part", part)
        .select(
            F.col("_id").alias(id_col),
            "text_md5",
            "size",
            "source_size",
            "target",
            (F.col("epochs") + ((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size"))).cast("long")).alias("copies"),
            (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
        )
    )


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row with its source's plan; ``_tag`` stands for the source, a null one too."""
    tag = F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("null"))
    return rows.withColumn("_tag", tag).drop("_source").join(plan.withColumn("_tag", tag).drop("_source"), "_tag")


def materialise_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most_epochs: int = 3, *, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as often as its ``copies`` say.

    The document in which a budget ends stays whole if at least half of it is taken.
    Repeated rows (same id and text) share the larger of their numbers.
    """
    decided = mix(docs, weights, most_epochs, id_col=id_col, text_col=text_col, **more)
    wanted = decided.groupBy(F.col(id_col).alias("__mix_id"), F.col("text_md5").alias("__mix_md5")).agg(F.max("copies").alias("__mix_copies")).where("__mix_copies > 0")
    # rows travel as one column, so none of theirs can be mistaken for these
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col(id_col).alias("own_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("own_md5"))
    joined = keyed.join(wanted, F.col("own_id").eqNullSafe(F.col("__mix_id")) & (F.col("own_md5") == F.col("__mix_md5")))
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
