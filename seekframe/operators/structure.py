"""Cutting texts into named pieces with SQL functions: line windows, markdown sections, links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_windows(files: DataFrame, size: int = 60) -> DataFrame:
    """id, name, line_start, line_end (1-based, inclusive), body: windows of ``size`` lines, blank ones left out.

    Names count the windows kept.
    """
    lines = F.split("text", "\n")
    starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(size))
    windows = F.transform(starts, lambda a: F.struct((a + 1).cast("bigint").alias("line_start"), F.least(a + size, F.size(lines)).cast("bigint").alias("line_end"), F.array_join(F.slice(lines, a + 1, F.lit(size)), "\n").alias("body")))
    kept = F.filter(windows, lambda w: w["body"].rlike(r"\S"))
    return files.where(F.col("text").isNotNull()).select("id", F.posexplode(kept).alias("n", "w")).select("id", F.concat(F.lit("section_"), F.col("n") + 1).alias("name"), "w.*")


def markdown_sections(files: DataFrame) -> DataFrame:
    """id, title, level, path, line_start, line_end of each ATX heading; a section ends before the next heading of its level or above.

    A path names the headings that enclose it.  All of a file's headings are one array, so no row leaves its task.
    """
    lines = F.split("text", "\n")
    marks = F.transform(lines, lambda x, i: F.struct(i.cast("bigint").alias("i"), F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1)).cast("bigint").alias("level"), F.regexp_extract(x, r"^#{1,6}\s+(.*?)\s*#*\s*$", 1).alias("title")))
    heads = files.where(F.col("text").isNotNull()).select("id", F.size(lines).cast("bigint").alias("n"), F.filter(marks, lambda m: m["level"] > 0).alias("h"))

    def section(m, k):
        later = F.filter("h", lambda x: (x["i"] > m["i"]) & (x["level"] <= m["level"]))
        end = F.coalesce(F.get(later, F.lit(0))["i"], F.col("n"))
        # going back from the heading, each one of a smaller level than all met so far encloses it
        start = F.struct(m["level"].alias("level"), F.array(m["title"]).alias("path"))
        above = F.aggregate(
            F.reverse(F.filter("h", lambda x: x["i"] < m["i"])),
            start,
            lambda s, x: F.when(x["level"] < s["level"], F.struct(x["level"].alias("level"), F.concat(F.array(x["title"]), s["path"]).alias("path"))).otherwise(s),
        )
        return F.struct(m["title"].alias("title"), m["level"].alias("level"), F.array_join(above["path"], " > ").alias("path"), (m["i"] + 1).alias("line_start"), end.alias("line_end"))

    return heads.select("id", F.explode(F.transform("h", section)).alias("s")).select("id", "s.*")


def html_links(pages: DataFrame) -> DataFrame:
    """id, links (how many), title."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select("id", F.size(links).cast("bigint").alias("links"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))
