"""Queries that run a stream over the tables, and parsers over their texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.functions.tables import checkpoint_folder
from seekframe.plans.tables import table
from seekframe.sources import parsers
from seekframe.streaming import watch


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return watch.files(spark, f"{sf_dir}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = watch.counts(_events(spark, sf_dir), "ts", "event_type", window="1 hour")
    out = watch.drain_updates(counts, _folder(spark), ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


WINDOW_SQL = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each run of a user's events; a run ends after half an hour without one."""
    folder = _folder(spark)
    events = _events(spark, sf_dir).select("user_id", "ts", "event_type", "event_id")
    last = table(spark, sf_dir, "events").agg(F.max("ts") + F.expr("INTERVAL 1 DAY")).first()[0]
    runs = watch.debounced(watch.closed(events, "ts", folder, last), "user_id", "ts", "30 minutes")
    return watch.drain(runs, folder).where("user_id IS NOT NULL").select("user_id", "event_id", "event_type", "events")


DEBOUNCE_SQL = """
WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events
), r AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, max_by(event_id, ts) AS event_id, max_by(event_type, ts) AS event_type, count(*) AS events FROM r GROUP BY user_id, run"""


def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, kept up to date by batches."""
    base = _folder(spark)
    stream = _events(spark, sf_dir).select("user_id", "event_id", "event_type")
    watch.index(stream, f"{base}/table", f"{base}/checkpoint", ["user_id"], "event_id").awaitTermination()
    found = watch.generation(spark, f"{base}/table")
    return found if found is not None else stream.limit(0)


INDEX_SQL = "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1"


SUBSCRIBED = [("click", "ann"), ("purchase", "ann"), ("purchase", "bo"), ("purchase", "bo"), ("none", "cy")]


def stream_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a change of the repository its type names, told to all who follow that."""
    folder = _folder(spark)
    changes = _events(spark, sf_dir).select(F.col("event_type").alias("repo"), "event_id")
    return watch.drain(watch.notified(changes, spark.createDataFrame(SUBSCRIBED, "repo string, subscriber string")), folder)


SUBSCRIBED_SQL = f"""
SELECT DISTINCT event_type AS repo, event_id, subscriber FROM events JOIN (VALUES {", ".join(str(s) for s in SUBSCRIBED)}) s(repo, subscriber) ON event_type = repo"""


def parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("rel_path"), F.lit("html").alias("language"), F.col("html").alias("text"))
    parsed = parsers.parse(files)
    return parsed.select(F.col("rel_path").cast("bigint").alias("page_id"), F.size(F.filter("symbols", lambda s: s["kind"] == "section")).cast("bigint").alias("sections"), F.size("imports").cast("bigint").alias("imports"))


PARSE_SQL = "SELECT page_id, len(regexp_extract_all(html, '<(header|nav|main|footer|aside|section|article|form)[ >]'))::BIGINT AS sections, 0::BIGINT AS imports FROM pages"


def parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of events as JSON files with one key."""
    files = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("rel_path"), F.lit("json").alias("language"), F.col("props").alias("text"))
    rows = parsers.symbols(parsers.parse(files))
    return rows.select(F.col("rel_path").cast("bigint").alias("event_id"), "name", "kind")


EVENTS_SQL = "SELECT event_id, 'k' AS name, 'constant' AS kind FROM events"

QUERIES = {
    "stream_window_counts": (stream_window_counts, WINDOW_SQL),
    "stream_debounce": (stream_debounce, DEBOUNCE_SQL),
    "stream_index": (stream_index, INDEX_SQL),
    "stream_subscriptions": (stream_subscriptions, SUBSCRIBED_SQL),
    "parse_pages": (parse_pages, PARSE_SQL),
    "parse_events": (parse_events, EVENTS_SQL),
}
