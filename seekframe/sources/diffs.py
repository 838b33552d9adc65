"""Unified diffs as rows of hunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hunks(diffs: DataFrame) -> DataFrame:
    """id, file, hunk, old_start, old_count, new_start, new_count, added, removed; a missing count is 1.

    ``diffs``: id, text.  A last hunk without a changed line is dropped, one in between is kept.
    """
    head = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    lines = diffs.select("id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    before = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("file", F.last(F.when(F.startswith("line", F.lit("+++ b/")), F.substring("line", 7, 1 << 20)), ignorenulls=True).over(before))
    lines = lines.withColumn("hunk", F.sum(F.col("line").rlike(head).cast("bigint")).over(before)).where("hunk > 0")
    mark = F.substring("line", 1, 1)
    changed = lambda c, skip: F.when((mark == c) & ~F.startswith("line", F.lit(skip)), F.struct("n", F.substring("line", 2, 1 << 20).alias("x")))
    number = lambda i: F.max(F.when(F.col("line").rlike(head), F.regexp_extract("line", head, i)))
    count = lambda i: F.coalesce(F.nullif(number(i), F.lit("")), F.lit("1")).cast("bigint")
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda v: v["x"]), "\n")
    out = lines.groupBy("id", "hunk").agg(F.first("file").alias("file"), number(1).cast("bigint").alias("old_start"), count(2).alias("old_count"), number(3).cast("bigint").alias("new_start"), count(4).alias("new_count"), text(changed("+", "+++")).alias("added"), text(changed("-", "---")).alias("removed"))
    last = F.max("hunk").over(Window.partitionBy("id"))
    return out.withColumn("last", last).where((F.col("hunk") < F.col("last")) | (F.col("added") != "") | (F.col("removed") != "")).drop("last")


def identifiers(hunk_text, most: int = 15):
    """The distinct words of three letters or more that a hunk names: five of each of the first ten changed lines."""
    lines = F.slice(F.split(hunk_text, "\n"), 1, 10)
    return F.slice(F.array_distinct(F.flatten(F.transform(lines, lambda x: F.slice(F.regexp_extract_all(x, F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), 1, 5)))), 1, most)
