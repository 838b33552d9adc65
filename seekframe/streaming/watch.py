"""Streams: debounced file events, incremental indexing, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seekframe.functions.tables import delete


def files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream of at most ``per_trigger`` files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def debounced(events: DataFrame, path: str, ts: str, gap: str = "500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """The last event of each run of events on one path; a run ends after ``gap`` without another.

    State is dropped once the watermark has passed a run's end.
    """
    rest = [c for c in events.columns if c not in (path, ts)]
    runs = events.withWatermark(ts, late).groupBy(path, F.session_window(ts, gap).alias("run"))
    return runs.agg(F.max_by(F.struct(ts, *rest), F.col(ts)).alias("last"), F.count(F.lit(1)).alias("events")).select(path, F.col(f"last.{ts}").alias(ts), *[F.col(f"last.{c}").alias(c) for c in rest], "events")


def unchanged_dropped(files_: DataFrame, ts: str, late: str = "10 minutes") -> DataFrame:
    """Without repeated contents of a path within the watermark; expects path and hash."""
    return files_.withWatermark(ts, late).dropDuplicatesWithinWatermark(["path", "hash"])


def notified(changes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row for each change (repo, ...) and each subscriber (repo, subscriber) of its repository; ``changes`` may be a stream."""
    return changes.join(subscriptions.select("repo", "subscriber").distinct(), "repo")


def counts(events: DataFrame, ts: str, *by: str, window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Events of each kind in each window, late ones within the watermark counted."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def index(stream: DataFrame, target: str, checkpoint: str, key: list[str], version: str, then: Callable[[DataFrame], None] | None = None):
    """Upserts each batch into the Parquet table ``target``: the latest version of a key wins, a repeated batch changes nothing.

    A batch writes a new generation of the table and then points to it, so a reader never sees
    half of one, and a batch that is run again writes the same generation again.  The generation
    before stays for readers; older ones are deleted.  A row whose column ``deleted`` is true stays
    as a mark, which keeps late news of its key out; ``alive`` leaves such rows out.
    """
    from seekframe.operators.incremental import upsert

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = generation(spark, target, number)
        merged = upsert(before, batch, key, version) if before is not None else upsert(batch.limit(0), batch, key, version)
        merged.write.mode("overwrite").parquet(f"{target}/generation={number}")
        if then is not None:
            then(spark.read.parquet(f"{target}/generation={number}"))
        for old in _generations(spark, target):
            if old < number - 1:
                delete(spark, f"{target}/generation={old}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alive(table: DataFrame) -> DataFrame:
    """An indexed table without the rows that are only marks of deleted ones."""
    return table.where(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in table.columns else table


def _generations(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the generations that are written to their end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    done = [s.getPath().getName().removeprefix("generation=") for s in system.listStatus(path) if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return [int(n) for n in done if n.isdigit()]


def generation(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The newest generation of an indexed table, or the newest one before batch ``before``."""
    numbers = [n for n in _generations(spark, target) if before is None or n < before]
    return spark.read.parquet(f"{target}/generation={max(numbers)}") if numbers else None


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream that only appends over all that is there; the result is a Parquet table below ``folder``."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def drain_updates(stream: DataFrame, folder: str, key: list[str]) -> DataFrame:
    """Runs a stream that updates its rows over all that is there: the last state of each key, open windows too.

    Each batch writes what changed in a folder of its own, so a batch that is run again replaces itself.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    written = stream.sparkSession.read.option("basePath", f"{folder}/table").schema(stream.schema.add("batch", "long")).parquet(f"{folder}/table")
    values = [c for c in stream.columns if c not in key]
    return written.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*key, *[F.col(f"last.{c}").alias(c) for c in values])


def closed(events: DataFrame, ts: str, folder: str, at) -> DataFrame:
    """``events`` and one more, at ``at`` and otherwise null, which ends all runs: without it the last ones stay open."""
    spark = events.sparkSession
    end = spark.range(1).select(*[(F.lit(at).cast(f.dataType) if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in events.schema])
    end.write.mode("overwrite").parquet(f"{folder}/end")
    return events.unionByName(spark.readStream.schema(events.schema).parquet(f"{folder}/end"))
