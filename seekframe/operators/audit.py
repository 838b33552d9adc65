"""A hash-chained log: each entry's hash covers its content and the hash before it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def content(*fields: Column | str) -> Column:
    """Canonical JSON of the fields in the order given (names sorted by the caller)."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def entry_hash(prev: Column, text: Column) -> Column:
    return F.sha2(F.concat(prev, text), 256)


def build(log: DataFrame, by: str, order: str) -> DataFrame:
    """``log`` (by, order, text) with id, prev_hash and entry_hash; one chain for each ``by``.

    A chain is sequential by nature; chains run in parallel.  A chain goes through a task as a
    stream of batches, so its length is no matter of memory.
    """
    import hashlib

    schema = f"`{by}` {log.schema[by].dataType.simpleString()}, id bigint, text string, prev_hash string, entry_hash string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, n, prev = None, 0, GENESIS
        for pdf in batches:
            rows = []
            for key, text in zip(pdf[by], pdf["text"], strict=True):
                if key != chain:
                    chain, n, prev = key, 0, GENESIS
                n += 1
                this = hashlib.sha256((prev + text).encode()).hexdigest()
                rows.append((key, n, text, prev, this))
                prev = this
            yield pd.DataFrame(rows, columns=[by, "id", "text", "prev_hash", "entry_hash"])

    return log.select(by, order, "text").repartition(by).sortWithinPartitions(by, order).select(by, "text").mapInPandas(run, schema)


def verify(log: DataFrame, by: str, anchors: DataFrame | None = None) -> DataFrame:
    """by, entries, fault, fault_id: the first fault of each chain, or an empty one.

    In this order: a gap in ids, a row whose prev_hash is not its predecessor's hash, a row
    whose content was changed; then, with ``anchors`` (by, count, head): no anchor, another
    count, another head.
    """
    order = Window.partitionBy(by).orderBy("id")
    rows = log.withColumn("before", F.coalesce(F.lag("entry_hash").over(order), F.lit(GENESIS))).withColumn("n", F.row_number().over(order))
    fault = F.when(F.col("id") != F.col("n"), "id_gap").when(F.col("prev_hash") != F.col("before"), "row_mislinked").when(F.col("entry_hash") != entry_hash(F.col("prev_hash"), F.col("text")), "row_mutated")
    rows = rows.withColumn("fault", fault)
    found = rows.groupBy(by).agg(F.count(F.lit(1)).alias("entries"), F.min(F.when(F.col("fault").isNotNull(), F.struct("id", "fault"))).alias("f"), F.max_by("entry_hash", "id").alias("head"))
    if anchors is None:
        return found.select(by, "entries", F.coalesce("f.fault", F.lit("")).alias("fault"), F.col("f.id").alias("fault_id"))
    met = found.join(anchors.select(by, F.col("count").alias("a_count"), F.col("head").alias("a_head")), by, "full_outer")
    late = F.when(F.col("entries").isNull(), "log_emptied").when(F.col("a_head").isNull(), "anchor_missing").when(~F.col("a_head").rlike("^[0-9a-f]{64}$"), "anchor_corrupt").when(F.col("entries") != F.col("a_count"), "count_mismatch").when(F.col("head") != F.col("a_head"), "head_mismatch")
    return met.select(by, F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("f.fault", late, F.lit("")).alias("fault"), F.col("f.id").alias("fault_id"))


def export(log: DataFrame, path: str) -> None:
    log.write.mode("overwrite").json(path)
