"""Queries on contexts, prompts, shortened hits, point reads and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.functions import text as T
from seekframe.operators import audit, context, fusion, graph, point, shorten
from seekframe.plans.retrieval import _hits, _rrf_sql
from seekframe.plans.tables import EDGES, SYMBOLS, part_edges, part_symbols, table
from seekframe.plans.upkeep import _chain

_WORDS = r"len(regexp_extract_all({}, '[^ \t\r\n]+'))::BIGINT"


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the legs found for each question, as symbols of files."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("class", "function", "method", "interface")]), (F.col("n_chars") % 4 + 1).cast("int"))
    name = F.concat(F.lit("doc"), "doc_id")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat_ws("/", "lang", "source").alias("rel_path"), kind.alias("kind"), name.alias("name"), F.concat_ws(".", "source", name).alias("qualified_name"),
        (F.col("n_chars") % 100).alias("line_start"), (F.col("n_chars") % 100 + 7).alias("line_end"), F.col("text").alias("body"), T.words(F.col("text")).alias("tokens"),
    )
    return fusion.rrf(_hits(spark, sf_dir)).select("query_id", "id", "rank").join(docs, "id")


_SHOWN = f"""s AS (SELECT x.query_id, x.rank, x.id, concat_ws('/', d.lang, d.source) AS rel_path, ['class', 'function', 'method', 'interface'][d.n_chars % 4 + 1] AS kind, 'doc' || x.id AS name, concat_ws('.', d.source, 'doc' || x.id) AS qualified_name,
  d.n_chars % 100 AS line_start, d.n_chars % 100 + 7 AS line_end, d.text AS body, {_WORDS.format("d.text")} AS tokens FROM ({_rrf_sql(limit=1000000)}) x JOIN documents d ON d.doc_id = x.id)"""

INTENTS = ["file_overview", "project_overview", "comparison", "symbol_lookup", "how_to"]


def preambles(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(q, i) for q in (1, 2, 3, 99) for i in INTENTS], "query_id bigint, intent string")
    return context.preamble(_shown(spark, sf_dir), asked).select("query_id", "intent", F.sha2("preamble", 256).alias("preamble_sha"))


PREAMBLES_SQL = f"""
WITH {_SHOWN}, a AS (SELECT query_id::BIGINT AS query_id, intent FROM (VALUES (1), (2), (3), (99)) q(query_id), (VALUES {", ".join(f"('{i}')" for i in INTENTS)}) i(intent)
), p AS (SELECT query_id, list_sort(list(DISTINCT rel_path)) AS paths, min_by('# Symbol: ' || qualified_name || ' (' || kind || ') — ' || rel_path, rank) AS symbol,
  string_agg('#   ' || kind || repeat(' ', greatest(0, 12 - length(kind))) || ' ' || name || repeat(' ', greatest(0, 40 - length(name))) || ' [lines ' || line_start || '-' || line_end || ']', chr(10) ORDER BY rank) FILTER (kind <> 'method') AS listed FROM s GROUP BY 1)
SELECT a.query_id, intent, sha256(coalesce(CASE WHEN p.query_id IS NULL THEN '' WHEN intent = 'file_overview' THEN concat_ws(chr(10), '# File Overview: ' || array_to_string(paths, ', '), '# Contents:', listed)
  WHEN intent = 'project_overview' THEN '# Project Architecture Overview' || chr(10) || '# Sources (' || len(paths) || ' files): ' || array_to_string(paths[1:8], ', ') || CASE WHEN len(paths) > 8 THEN chr(10) || '#   ... and ' || (len(paths) - 8) || ' more' ELSE '' END
  WHEN intent = 'comparison' THEN '# Comparison' WHEN intent = 'symbol_lookup' THEN symbol END, '')) AS preamble_sha FROM a LEFT JOIN p ON p.query_id = a.query_id"""


def map_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.map_groups(_shown(spark, sf_dir)).select("query_id", "grp", "hits", F.sha2("context", 256).alias("context_sha"))


MAP_SQL = rf"""
WITH {_SHOWN}, w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, count(*) OVER (PARTITION BY query_id) AS many, sum(tokens) OVER (PARTITION BY query_id) AS used FROM s)
SELECT query_id, (n - 1) // 10 AS grp, count(*) AS hits, sha256(string_agg('# ' || rel_path || ' — ' || name || ' (' || kind || ')' || chr(10) || regexp_replace(body, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY n)) AS context_sha
FROM w WHERE used > 8000 OR many > 20 GROUP BY 1, 2"""


def reduce_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation are the answers to its groups; short ones are blank."""
    c = table(spark, sf_dir, "conversations")
    answers = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("grp"), F.when(F.length("text") < 40, " \n").otherwise(F.col("text")).alias("answer"))
    return context.reduce_groups(answers).select("query_id", F.sha2("partials", 256).alias("partials_sha"))


REDUCE_SQL = r"""
WITH a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, regexp_replace(text, '^\s+|\s+$', '', 'g') AS answer FROM conversations WHERE length(text) >= 40 AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')
SELECT conv_id AS query_id, sha256(string_agg('[Partial ' || n || ']' || chr(10) || answer, chr(10) || chr(10) ORDER BY n)) AS partials_sha FROM a GROUP BY 1"""

WINDOWS = [("brand#11", 2000), ("brand#1", 900), ("BRAND#2", 77), ("brand#2", 5)]


def window_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", context.window_budget(F.col("p_brand"), WINDOWS).alias("budget"))


WINDOWS_SQL = "SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#11%' THEN 1000 WHEN p_brand LIKE 'Brand#1%' THEN 450 WHEN p_brand LIKE 'Brand#2%' THEN 38 ELSE 12000 END::BIGINT AS budget FROM part"


def review_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a hunk that adds its text; two of three have a context."""
    d = table(spark, sf_dir, "documents")
    hunks = d.select(F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("hunk"), F.col("source").alias("file"), (F.col("n_chars") % 50).alias("new_start"), (F.col("n_chars") % 7).alias("new_count"), F.when(F.col("n_chars") % 2 == 0, F.col("lang")).otherwise("").alias("removed"), F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit("`"), (F.col("doc_id") % 5).cast("int"))).alias("added"))
    contexts = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("hunk"), F.col("text").alias("context"))
    return context.review_prompts(hunks, contexts).select("id", F.sha2("prompt", 256).alias("prompt_sha"))


_FENCE = "repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all({0}, '`+'), lambda x: length(x))), 0) + 1)::INTEGER)"
REVIEW_SQL = f"""
WITH d AS (SELECT *, CASE WHEN n_chars % 2 = 0 THEN '- ' || lang || chr(10) ELSE '' END || CASE WHEN coalesce(text, '') || repeat('`', (doc_id % 5)::INTEGER) <> '' THEN '+ ' || replace(coalesce(text, '') || repeat('`', (doc_id % 5)::INTEGER), chr(10), chr(10) || '+ ') ELSE '' END AS diff, CASE WHEN doc_id % 3 <> 0 THEN coalesce(substr(text, 1, 3000), '') ELSE '' END AS ctx FROM documents)
SELECT doc_id AS id, sha256('File: ' || source || ' (lines ' || n_chars % 50 || '–' || (n_chars % 50 + n_chars % 7) || ')' || chr(10) || chr(10) || 'Changed code:' || chr(10) || {_FENCE.format("diff")} || chr(10) || diff || chr(10) || {_FENCE.format("diff")} || chr(10) || chr(10)
  || CASE WHEN ctx <> '' THEN 'Related codebase context:' || chr(10) || {_FENCE.format("ctx")} || chr(10) || ctx || chr(10) || {_FENCE.format("ctx")} || chr(10) || chr(10) ELSE '' END || 'Provide review comments as a JSON array.') AS prompt_sha FROM d"""


def summary_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = part_symbols(spark, sf_dir)
    symbols = s.select(F.col("grp").alias("file_id"), "id", (F.col("id") % 100).alias("line"), "kind", "qualified_name", F.concat(F.repeat("qualified_name", 5), F.lit("("), "id", F.lit(")")).alias("signature"))
    files = s.select(F.col("grp").alias("file_id")).distinct().select("file_id", F.concat("file_id", F.lit(".py")).alias("rel_path"), F.lit("python").alias("language"))
    return context.summary_prompts(symbols, files).select("file_id", F.sha2("prompt", 256).alias("prompt_sha"))


SUMMARY_SQL = f"""
WITH {SYMBOLS}, r AS (SELECT grp, '- ' || kind || ' ' || qualified_name || ': ' || substr(repeat(qualified_name, 5) || '(' || id || ')', 1, 80) AS line, row_number() OVER (PARTITION BY grp ORDER BY id % 100, id) AS n FROM sym)
SELECT grp AS file_id, sha256('File: ' || grp || '.py' || chr(10) || 'Language: python' || chr(10) || chr(10) || 'Top symbols:' || chr(10) || string_agg(line, chr(10) ORDER BY n) || chr(10) || chr(10) || 'Write a 2-4 sentence summary of what this file does.') AS prompt_sha FROM r WHERE n <= 30 GROUP BY grp"""


def concept_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.concept_batches(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("rank")))


CONCEPT_SQL = "SELECT id, (place - 1) // 20 AS batch, place FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS place FROM documents) WHERE place <= 200"


def second_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _shown(spark, sf_dir).withColumn("query", F.lit("the erin tion and license")).withColumn("docstring", T.first_line(F.col("body")))
    return shorten.second_wave(hits, 3000).select("query_id", "id", "rank", "tokens", "how", F.sha2("text", 256).alias("text_sha"))


def shortened_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document to a third of its words."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("the erin tion and license").alias("query"), F.col("text").alias("body"), F.lit(None).cast("string").alias("docstring"), T.words(F.col("text")).alias("tokens"))
    return shorten.shortened(d, 1 / 3).select("id", "tokens", F.size("spans").cast("long").alias("spans"), F.sha2("text", 256).alias("text_sha"))


def drawn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    communities = table(spark, sf_dir, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.col("p_size").cast("long").alias("community"))
    return graph.drawn(part_edges(spark, sf_dir), communities)


DRAWN_SQL = f"""
WITH {EDGES}, t AS MATERIALIZED (SELECT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id ORDER BY count(*) DESC, id LIMIT 500
), i AS MATERIALIZED (SELECT src, dst FROM e WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)), g AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM i UNION ALL SELECT dst FROM i) GROUP BY id)
SELECT t.id, p_size::BIGINT AS community, coalesce(n, 0) AS degree, least(50, 10 + coalesce(n, 0) * 3)::BIGINT AS size, p_size::BIGINT % 10 AS colour FROM t LEFT JOIN g ON g.id = t.id LEFT JOIN part ON 'p:' || p_partkey = t.id"""


def largest_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.largest_communities(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("community")))


LARGEST_SQL = """
SELECT row_number() OVER (ORDER BY size DESC, community) AS place, community, size, round(size / (SELECT count(*) FROM part)::DOUBLE, 6) AS share
FROM (SELECT p_type AS community, count(*) AS size FROM part GROUP BY 1 ORDER BY size DESC, community LIMIT 5)"""


def community_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands are the communities before; three parts changed."""
    before = table(spark, sf_dir, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.concat(F.lit("b:"), "p_brand").alias("community"))
    seeds = spark.createDataFrame([("p:1",), ("p:7",), ("p:42",)], "id string")
    return graph.update_communities(part_edges(spark, sf_dir), seeds, before)


def files_importing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point.files_importing(part_symbols(spark, sf_dir).select(F.col("grp").alias("file_id"), F.col("qualified_name").alias("specifier")), "brand1")


def _chunked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each line of an order is a chunk of its part; parts are symbols of their type's file."""
    chunks = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_partkey").alias("symbol_id"))
    return chunks, part_symbols(spark, sf_dir).withColumnRenamed("grp", "file_id")


def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, symbols = _chunked(spark, sf_dir)
    return point.chunks_of_files(chunks, symbols, symbols.select("file_id").distinct())


def name_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, symbols = _chunked(spark, sf_dir)
    return point.chunks_of_names(chunks, symbols, symbols.where("kind = 'class'").select("file_id", "qualified_name"))


_CHUNKS = f"{SYMBOLS}, c AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_partkey AS symbol_id FROM lineitem)"
NAME_CHUNKS_SQL = f"""
WITH {_CHUNKS} SELECT grp AS file_id, qualified_name, chunk_id FROM c JOIN sym ON id = symbol_id WHERE (grp, qualified_name) IN (SELECT (grp, qualified_name) FROM sym WHERE kind = 'class')"""


def outside_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are symbols, the states of their orders what they refer to."""
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit("ticket:"), "o_orderstatus").alias("source_ref"))
    found = point.targets(edges, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))
    return found.select("id", F.array_join("refs", ",").alias("refs"))


TARGETS_SQL = "SELECT c_custkey AS id, coalesce(string_agg(DISTINCT 'ticket:' || o_orderstatus, ',' ORDER BY 'ticket:' || o_orderstatus), '') AS refs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


def artifacts_by_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items are artifacts; every second number up to that of the documents is asked for."""
    artifacts = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item:"), "item_id").alias("source_ref"), F.col("text").alias("body"))
    refs = table(spark, sf_dir, "documents").select(F.concat(F.lit("item:"), F.col("doc_id") * 2).alias("ref"))
    return point.artifacts_by_ref(artifacts, refs)


ARTIFACT_SQL = "SELECT 'item:' || doc_id * 2 AS ref, b.text AS body FROM documents LEFT JOIN benchmark b ON item_id::VARCHAR = (doc_id * 2)::VARCHAR"


def data_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are uses of what their user defined before."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol_id"), F.col("event_type").alias("var_name"), (F.col("event_id") % 97).alias("def_line"), F.col("event_id").alias("use_line"), F.lit("use").alias("edge_type"))
    return point.flows(e, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol_id")))


FLOWS_SQL = """
SELECT user_id AS symbol_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 97, event_id, event_type) AS n, event_type AS var_name, event_id % 97 AS def_line, event_id AS use_line, 'use' AS edge_type
FROM events WHERE user_id IN (SELECT c_custkey FROM customer)"""


def taint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    found = d.select(F.col("source").alias("source_file"), (F.col("n_chars") % 100).alias("source_line"), F.concat("source", F.lit(".sink")).alias("sink_file"), F.col("doc_id").alias("sink_line"), F.lit("r").alias("rule_id"), F.element_at(F.array(*[F.lit(x) for x in ("ERROR", "WARNING", "INFO")]), (F.col("doc_id") % 3 + 1).cast("int")).alias("severity"))
    return point.taint(found, "WARNING")


TAINT_SQL = """
SELECT source AS source_file, n_chars % 100 AS source_line, source || '.sink' AS sink_file, doc_id AS sink_line, 'r' AS rule_id, 'WARNING' AS severity FROM documents WHERE doc_id % 3 = 1 ORDER BY source_file, source_line, sink_file, sink_line LIMIT 50"""


def settings_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names are set by their orders, and unset by those that failed."""
    settings = table(spark, sf_dir, "customer").select(F.concat(F.lit("c."), "c_custkey").alias("key"), F.lit("new").alias("value"))
    changes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("c."), "o_custkey").alias("key"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("value"))
    return point.settings_under(point.settings_after(settings, changes), "c.1")


SETTINGS_SQL = """
WITH o AS (SELECT o_custkey, max_by(CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus ELSE '' END, o_orderkey) AS v FROM orders GROUP BY 1), k AS (SELECT c_custkey AS c FROM customer UNION SELECT o_custkey FROM o)
SELECT 'c.' || c AS key, coalesce(v, 'new') AS value FROM k LEFT JOIN o ON o_custkey = c WHERE coalesce(v, 'new') <> '' AND starts_with('c.' || c, 'c.1')"""


def file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point.contents(part_symbols(spark, sf_dir).withColumn("line", F.col("id") % 100))


CONTENTS_SQL = f"""
WITH {SYMBOLS} SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY CASE kind WHEN 'module' THEN 0 WHEN 'class' THEN 1 WHEN 'interface' THEN 2 WHEN 'function' THEN 3 WHEN 'method' THEN 4 ELSE 5 END, id % 100, id) AS n, id, kind FROM sym"""


def changed_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("hash"))
    return point.changed(e, "user_id").select("user_id", F.col("seq").alias("event_id"))


CHANGED_SQL = """
SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE n = 1 OR event_type IS DISTINCT FROM before"""


def audit_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole chains against anchors, of which some are lost, damaged or of another state; one chain was emptied."""
    log = _chain(spark, sf_dir)
    kind = F.col("user_id") % 5
    heads = log.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("entry_hash", "id").alias("h")).where(kind != 1)
    anchors = heads.select("user_id", (F.col("n") + (kind == 3).cast("long")).alias("count"), F.when(kind == 2, "x").when(kind == 4, audit.GENESIS).otherwise(F.col("h")).alias("head"))
    lost = spark.createDataFrame([(-1, 4, audit.GENESIS)], anchors.schema)
    return audit.verify(log, "user_id", anchors.unionByName(lost))


ANCHORS_SQL = """
SELECT user_id, count(*) AS entries, CASE user_id % 5 WHEN 1 THEN 'anchor_missing' WHEN 2 THEN 'anchor_corrupt' WHEN 3 THEN 'count_mismatch' WHEN 4 THEN 'head_mismatch' ELSE '' END AS fault, NULL::BIGINT AS fault_id FROM events GROUP BY user_id
UNION ALL SELECT -1, 0, 'log_emptied', NULL"""

QUERIES = {
    "preambles": (preambles, PREAMBLES_SQL),
    "map_groups": (map_groups, MAP_SQL),
    "reduce_groups": (reduce_groups, REDUCE_SQL),
    "window_budgets": (window_budgets, WINDOWS_SQL),
    "review_prompts": (review_prompts, REVIEW_SQL),
    "summary_prompts": (summary_prompts, SUMMARY_SQL),
    "concept_batches": (concept_batches, CONCEPT_SQL),
    # sequential, over text: tests/test_context.py holds them against hand-worked cases
    "second_wave": (second_wave, None),
    "shortened_units": (shortened_units, None),
    "drawn_graph": (drawn_graph, DRAWN_SQL),
    "largest_communities": (largest_communities, LARGEST_SQL),
    # rounds of labels: tests/test_context.py holds it against a plain version
    "community_update": (community_update, None),
    "files_importing": (files_importing, f"WITH {SYMBOLS} SELECT DISTINCT grp AS file_id FROM sym WHERE contains(qualified_name, 'brand1')"),
    "file_chunks": (file_chunks, f"WITH {_CHUNKS} SELECT grp AS file_id, chunk_id FROM c JOIN sym ON id = symbol_id"),
    "name_chunks": (name_chunks, NAME_CHUNKS_SQL),
    "outside_targets": (outside_targets, TARGETS_SQL),
    "artifacts_by_ref": (artifacts_by_ref, ARTIFACT_SQL),
    "data_flows": (data_flows, FLOWS_SQL),
    "taint_report": (taint_report, TAINT_SQL),
    "settings_after": (settings_after, SETTINGS_SQL),
    "file_contents": (file_contents, CONTENTS_SQL),
    "changed_contents": (changed_contents, CHANGED_SQL),
    "audit_anchors": (audit_anchors, ANCHORS_SQL),
}
