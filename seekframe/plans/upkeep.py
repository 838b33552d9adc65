"""Queries on upkeep, statistics, logs and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seekframe.functions import text as T
from seekframe.operators import audit, incremental, metrics, stats
from seekframe.plans.tables import table


def _disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of one corpus, which is what drift is about: here some files are gone and some changed, below some are not indexed yet."""
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.where("doc_id % 10 <> 2").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2(text, 256).alias("hash"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 10 <> 3")
    return d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("hash"))


_DRIFT = """d AS (SELECT source || '/' || doc_id AS path, sha256(CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END) AS now FROM documents WHERE doc_id % 10 <> 2
), i AS (SELECT source || '/' || doc_id AS path, sha256(text) AS was FROM documents WHERE doc_id % 10 <> 3
), s AS (SELECT path, CASE WHEN now IS NULL THEN 'missing' WHEN was IS NULL THEN 'new' WHEN now <> was THEN 'stale' ELSE 'unchanged' END AS state FROM d FULL JOIN i USING (path))"""


def drift_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.drift(_disk(spark, sf_dir), _index(spark, sf_dir))


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.drift_report(drift_states(spark, sf_dir))


REPORT_SQL = f"WITH {_DRIFT} SELECT " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("new", "stale", "unchanged", "missing")) + " FROM s"


def prune_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.prune_plan(drift_states(spark, sf_dir))


PRUNE_SQL = f"""
WITH {_DRIFT}, c AS (SELECT count(*) FILTER (state = 'missing') AS candidates, count(*) FILTER (state <> 'new') AS indexed FROM s), f AS (SELECT *, round(candidates / indexed::DOUBLE, 6) AS fraction FROM c)
SELECT *, CASE WHEN candidates > 10 AND fraction > 0.1::DOUBLE THEN 'too_many' ELSE '' END AS refused FROM f"""


def _ids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents").select((2 * F.col("doc_id")).alias("id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))


def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, vectors = _ids(spark, sf_dir)
    return incremental.without(chunks, vectors, ["id"])


def orphan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, vectors = _ids(spark, sf_dir)
    return incremental.without(vectors, chunks, ["id"])


def vector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.coverage(*_ids(spark, sf_dir))


_IDS = "c AS (SELECT 2 * doc_id AS id FROM documents), v AS (SELECT vec_id AS id FROM embeddings)"


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"), "o_orderstatus")
    return incremental.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


UPSERT_SQL = "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1"


def symbol_hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of one table: some rows are new, some are gone, some changed."""
    p = table(spark, sf_dir, "part")
    old = p.where("p_partkey % 7 <> 0").select("p_partkey", F.sha2(F.concat("p_name", "p_brand"), 256).alias("content"))
    new = p.where("p_partkey % 5 <> 0").select("p_partkey", F.sha2(F.concat("p_name", F.when(F.col("p_size") > 40, "x").otherwise(F.col("p_brand"))), 256).alias("content"))
    return incremental.diff(old, new, ["p_partkey"], "content")


DIFF_SQL = """
WITH o AS (SELECT p_partkey, sha256(p_name || p_brand) AS was FROM part WHERE p_partkey % 7 <> 0), n AS (SELECT p_partkey, sha256(p_name || CASE WHEN p_size > 40 THEN 'x' ELSE p_brand END) AS now FROM part WHERE p_partkey % 5 <> 0)
SELECT p_partkey, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN was <> now THEN 'changed' ELSE 'same' END AS change FROM o FULL JOIN n USING (p_partkey)"""


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    left = incremental.cascade_delete(gone, {"lines": (table(spark, sf_dir, "lineitem"), "l_orderkey")})
    return left["lines"].groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("lines_left"))


CASCADE_SQL = "SELECT l_returnflag, count(*) AS lines_left FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"


def dimension_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.vector_width(table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("v")), 64)


def cost_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.cost(table(spark, sf_dir, "documents").select(T.words(F.col("text")).alias("tokens")), 0.13)


COST_SQL = r"WITH t AS (SELECT len(regexp_extract_all(text, '[^ \t\r\n]+'))::BIGINT AS tokens FROM documents) SELECT count(*) AS chunks, sum(tokens)::BIGINT AS tokens, round(sum(tokens) * 0.13::DOUBLE / 1e6, 6) AS cost FROM t"


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.corpus(table(spark, sf_dir, "documents"), "lang", "source", F.col("n_chars"))


CORPUS_SQL = "SELECT lang, count(*) AS docs, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1"


def top_sources_per_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_groups(table(spark, sf_dir, "documents"), "lang", "source", 3)


TOP_SQL = "SELECT lang, source, n, rank FROM (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY 1, 2) WHERE rank <= 3"


def top_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_directories(table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".md"))).alias("path")))


DIRS_SQL = """
WITH f AS (SELECT DISTINCT source AS a, source || '/' || lang AS b FROM documents), n AS (SELECT count(DISTINCT a) AS n FROM f)
SELECT DISTINCT CASE WHEN n <= 2 THEN b ELSE a END AS dir FROM f, n ORDER BY 1 LIMIT 12"""


def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with its parts, those without any too."""
    return stats.left_counts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


TOTALS_SQL = "SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency(table(spark, sf_dir, "events"), F.col("value"), "event_type")


LATENCY_SQL = """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n, max(CASE WHEN i = n // 2 THEN value END) AS p50, max(CASE WHEN i = floor(n * 0.95::DOUBLE) THEN value END) AS p95 FROM r GROUP BY ALL"""


def telemetry_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("value"), 4).alias("mean_value"), F.max("k").alias("max_k"), F.countDistinct("user_id").alias("users"))


TELEMETRY_SQL = "SELECT event_type, count(*) AS queries, round(avg(value), 4) AS mean_value, max(json_extract_string(props, '$.k')::BIGINT) AS max_k, count(DISTINCT user_id) AS users FROM events GROUP BY 1"


def telemetry_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(25).select("event_id", "event_type", "value")


def rate_limit_sliding_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a user in the 60 seconds up to each one, and whether more than one would wait."""
    back = Window.partitionBy("user_id").orderBy("us").rangeBetween(-60_000_000, 0)
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.count(F.lit(1)).over(back).alias("in_minute")).withColumn("over", F.col("in_minute") > 1)


RATE_SQL = """
WITH e AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS in_minute FROM events)
SELECT event_id, in_minute, in_minute > 1 AS over FROM e"""


def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.date_trunc("HOUR", F.col("ts")).cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("value"), 2).alias("spent"))
    return e.where("requests >= 12")


WINDOWS_SQL = "SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, round(sum(value), 2) AS spent FROM events GROUP BY 1 HAVING count(*) >= 12"


def debounce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a user's events that follow each other within 30 minutes only the last counts."""
    return stats.debounce(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", "ts", "event_id", 1800)


DEBOUNCE_SQL = """
WITH e AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
SELECT event_id, user_id, event_type FROM e WHERE next IS NULL OR epoch_us(next) - epoch_us(ts) > 1800000000"""


def evict_stale_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kept, gone = incremental.latest_sessions(e.select(F.col("user_id").alias("session"), "ts"), "2024-01-31 00:00:00", 2 * 86400)
    return kept.select("session", F.lit(True).alias("kept")).unionByName(gone.select("session", F.lit(False).alias("kept")))


EVICT_SQL = "SELECT user_id AS session, NOT (epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts))) > 172800) AS kept FROM events GROUP BY 1"


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", audit.content(F.col("event_id"), F.col("event_type")).alias("text"))
    return audit.build(e, "user_id", "event_id")


def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir).select("user_id", "id", "prev_hash", "entry_hash")


AUDIT_SQL = """
WITH RECURSIVE t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS text FROM events
), c AS (SELECT user_id, id, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || text) AS entry_hash FROM t WHERE id = 1
  UNION ALL SELECT t.user_id, t.id, c.entry_hash, sha256(c.entry_hash || t.text) FROM c JOIN t ON t.user_id = c.user_id AND t.id = c.id + 1)
SELECT * FROM c"""


def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains after tampering: entries of some users are changed, relinked or lost."""
    log = _chain(spark, sf_dir)
    log = log.where(~((F.col("user_id") % 5 == 1) & (F.col("id") == 3)))
    log = log.withColumn("text", F.when((F.col("user_id") % 5 == 2) & (F.col("id") == 4), "{}").otherwise(F.col("text")))
    log = log.withColumn("prev_hash", F.when((F.col("user_id") % 5 == 3) & (F.col("id") == 2), audit.GENESIS).otherwise(F.col("prev_hash")))
    return audit.verify(log, "user_id")


VERIFY_SQL = """
SELECT user_id, count(*) - (user_id % 5 = 1 AND count(*) >= 3)::BIGINT AS entries,
  CASE WHEN user_id % 5 = 1 AND count(*) >= 4 THEN 'id_gap' WHEN user_id % 5 = 2 AND count(*) >= 4 THEN 'row_mutated' WHEN user_id % 5 = 3 AND count(*) >= 2 THEN 'row_mislinked' ELSE '' END AS fault,
  CASE WHEN user_id % 5 IN (1, 2) AND count(*) >= 4 THEN 4 WHEN user_id % 5 = 3 AND count(*) >= 2 THEN 2 END::BIGINT AS fault_id
FROM events GROUP BY user_id"""


def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking(*_judged(spark, sf_dir), 10)


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries are sources; their documents by length are the ranking, good ones are relevant."""
    d = table(spark, sf_dir, "documents")
    order = Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    found = d.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.row_number().over(order).alias("rank"))
    relevant = table(spark, sf_dir, "labels").where("quality = 1").join(d, "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"))
    return found, relevant


_METRICS = """r AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents
), g AS (SELECT source AS query_id, doc_id AS id FROM labels JOIN documents USING (doc_id) WHERE quality = 1
), z AS (SELECT query_id, count(*) AS size FROM g GROUP BY 1
), h AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS gain, count(*) FILTER (rank <= 10) AS met, min(rank) AS first FROM r JOIN g USING (query_id, id) GROUP BY 1
), m AS (SELECT query_id, round(coalesce(gain, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= size), 6) AS ndcg, round(coalesce(met, 0) / size::DOUBLE, 6) AS recall, round(coalesce(1 / first::DOUBLE, 0), 6) AS mrr FROM z LEFT JOIN h USING (query_id))"""


def ranking_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.means(ranking_metrics(spark, sf_dir))


def synthesis_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers are assistant turns; what they should name are words of the question before."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    q = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    both = a.join(q, ["conv_id", "turn"])
    words = T.terms(F.col("question"))
    both = both.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "answer", F.slice(words, 1, 4).alias("expected"), F.slice(words, 3, 4).alias("fragments"), F.slice(words, 1, 2).alias("retrieved"), F.col("question").alias("context"))
    return metrics.synthesis(both)


SYNTHESIS_SQL = """
WITH b AS (SELECT a.conv_id * 1000 + a.turn AS query_id, lower(a.text) AS answer, lower(q.text) AS context, regexp_extract_all(lower(q.text), '[a-z_][a-z0-9_]*') AS w, regexp_extract_all(lower(a.text), '[a-z0-9_]{4,}') AS t
  FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn WHERE a.role = 'assistant' AND q.role = 'user'
), p AS (SELECT query_id,
  CASE WHEN len(w[1:4]) > 0 THEN len(list_filter(w[1:4], lambda s: contains(answer, s) AND NOT list_contains(w[1:2], s))) / len(w[1:4])::DOUBLE ELSE 0 END AS h,
  CASE WHEN len(w[3:6]) > 0 THEN len(list_filter(w[3:6], lambda s: contains(answer, s))) / len(w[3:6])::DOUBLE ELSE 1 END AS c,
  CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda s: contains(context, s))) / len(t)::DOUBLE ELSE 0 END AS f FROM b)
SELECT query_id, round(h, 6) AS hallucination, round(c, 6) AS completeness, round(f, 6) AS faithfulness, round(0.4::DOUBLE * (1 - h) + 0.4::DOUBLE * c + 0.2::DOUBLE * f, 6) AS overall FROM p"""

QUERIES = {
    "drift_states": (drift_states, f"WITH {_DRIFT} SELECT * FROM s"),
    "drift_report": (drift_report, REPORT_SQL),
    "prune_plan": (prune_plan, PRUNE_SQL),
    "missing_vectors": (missing_vectors, f"WITH {_IDS} SELECT id FROM c WHERE id NOT IN (SELECT id FROM v)"),
    "orphan_vectors": (orphan_vectors, f"WITH {_IDS} SELECT id FROM v WHERE id NOT IN (SELECT id FROM c)"),
    "vector_coverage": (vector_coverage, f"WITH {_IDS} SELECT count(*) FILTER (c.id IS NOT NULL AND v.id IS NOT NULL) AS with_vector, count(*) FILTER (v.id IS NULL) AS without_vector, count(*) FILTER (c.id IS NULL) AS orphaned FROM c FULL JOIN v ON c.id = v.id"),
    "upsert_latest": (upsert_latest, UPSERT_SQL),
    "symbol_hash_diff": (symbol_hash_diff, DIFF_SQL),
    "cascade_delete": (cascade_delete, CASCADE_SQL),
    "dimension_guard": (dimension_guard, "SELECT len(embedding) AS width, count(*) AS n, len(embedding) = 64 AS fits FROM embeddings GROUP BY ALL"),
    "cost_preview": (cost_preview, COST_SQL),
    "corpus_stats": (corpus_stats, CORPUS_SQL),
    "top_sources_per_lang": (top_sources_per_lang, TOP_SQL),
    "top_directories": (top_directories, DIRS_SQL),
    "source_totals": (source_totals, TOTALS_SQL),
    "latency_percentiles": (latency_percentiles, LATENCY_SQL),
    "telemetry_by_kind": (telemetry_by_kind, TELEMETRY_SQL),
    "telemetry_recent": (telemetry_recent, "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 25"),
    "rate_limit_sliding_60s": (rate_limit_sliding_60s, RATE_SQL),
    "rate_limit_windows": (rate_limit_windows, WINDOWS_SQL),
    "debounce_events": (debounce_events, DEBOUNCE_SQL),
    "evict_stale_sessions": (evict_stale_sessions, EVICT_SQL),
    "audit_chain": (audit_chain, AUDIT_SQL),
    "audit_verify": (audit_verify, VERIFY_SQL),
    "ranking_metrics": (ranking_metrics, f"WITH {_METRICS} SELECT * FROM m"),
    "ranking_means": (ranking_means, f"WITH {_METRICS} SELECT count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM m"),
    "synthesis_metrics": (synthesis_metrics, SYNTHESIS_SQL),
}
