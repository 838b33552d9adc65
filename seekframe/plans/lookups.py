"""Queries on lookups, listings and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.functions import text as T
from seekframe.operators import lookup
from seekframe.plans.retrieval import _bm25_sql, bm25_topk
from seekframe.plans.tables import SYMBOLS, part_symbols, table
from seekframe.sources import diffs, walk


def symbols_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = part_symbols(spark, sf_dir)
    names = s.select(F.col("name").alias("asked")).unionByName(s.select(F.col("qualified_name").alias("asked"))).distinct()
    return lookup.by_name(s, names)


BY_NAME_SQL = f"""
WITH {SYMBOLS}, a AS (SELECT DISTINCT name AS asked FROM sym UNION SELECT qualified_name FROM sym)
SELECT DISTINCT asked, id FROM a JOIN sym ON name = asked OR qualified_name = asked"""


def top_symbols_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = part_symbols(spark, sf_dir).withColumn("line", F.col("id") % 100)
    return lookup.top_per_file(s, 30).select("grp", "id", "kind", "n")


TOP_SQL = f"""
WITH {SYMBOLS} SELECT grp, id, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 WHEN 'method' THEN 2 ELSE 3 END, id % 100, id) AS n FROM sym) WHERE n <= 30"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    extension = F.element_at(F.array(*[F.lit(x) for x in ("py", "JSON", "md", "env", "unknown", "ts", "tf")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 11 == 0, "Dockerfile.prod").otherwise(F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("."), extension))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.concat_ws("/", "p_type", "p_brand", name).alias("rel_path"))


_FILES = """f AS (SELECT p_partkey AS file_id, p_type || '/' || p_brand || '/' || CASE WHEN p_partkey % 11 = 0 THEN 'Dockerfile.prod' ELSE replace(p_name, ' ', '_') || '.' || ['py', 'JSON', 'md', 'env', 'unknown', 'ts', 'tf'][p_partkey % 7 + 1] END AS rel_path FROM part)"""


def path_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.path_fragment(_files(spark, sf_dir), "Dockerfile")


def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("rel_path")
    return _files(spark, sf_dir).groupBy(walk.language(path).alias("language"), lookup.is_config(path).alias("config")).agg(F.count(F.lit(1)).alias("files"))


LANGUAGES_SQL = f"""
WITH {_FILES}, e AS (SELECT CASE WHEN rel_path LIKE '%Dockerfile.prod' THEN 'D' ELSE split_part(rel_path, '.', -1) END AS x FROM f)
SELECT CASE x WHEN 'D' THEN 'dockerfile' WHEN 'py' THEN 'python' WHEN 'JSON' THEN 'json' WHEN 'md' THEN 'markdown' WHEN 'ts' THEN 'typescript' ELSE 'unknown' END AS language, x IN ('D', 'JSON', 'tf') AS config, count(*) AS files FROM e GROUP BY ALL"""


def hydrated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the documents have a chunk; of the rest the body is shown, as far as the operator shows one."""
    d = table(spark, sf_dir, "documents")
    chunks = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("symbol_id"), F.col("doc_id").alias("chunk_id"), "text", F.col("n_chars").alias("tokens"))
    symbols = d.select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("body"))
    return lookup.hydrate(bm25_topk(spark, sf_dir).select(F.col("id").alias("symbol_id")).distinct(), chunks, symbols)


HYDRATE_SQL = f"""
WITH b AS ({_bm25_sql()}), i AS (SELECT DISTINCT id FROM b)
SELECT doc_id AS symbol_id, source AS name, CASE WHEN doc_id % 3 <> 0 THEN text ELSE substr(text, 1, 2000) END AS text, CASE WHEN doc_id % 3 <> 0 THEN n_chars ELSE 0 END::BIGINT AS tokens FROM i JOIN documents ON doc_id = i.id"""


def community_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))
    return lookup.same_community(nodes, nodes.where("id IN (3, 8)").select("id"))


CONTEXT_SQL = "SELECT p_partkey AS id, p_brand AS community FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey IN (3, 8))"


def latest_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of a user with the purchase before it: the last definition that a use refers to."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    found = lookup.latest_before(e, "user_id", ["event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return found.where("event_type = 'click' AND latest IS NOT NULL").select("event_id", F.col("latest").alias("definition"))


LATEST_SQL = """
SELECT event_id, definition FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS definition FROM events)
WHERE event_type = 'click' AND definition IS NOT NULL"""


def hunk_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(diffs.identifiers(F.col("text")), " ").alias("query"))
    return d


IDENTIFIERS_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10))[1:10] AS x FROM documents)
), w AS (SELECT doc_id, i, generate_subscripts(t, 1) AS j, unnest(t) AS w FROM (SELECT doc_id, i, regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]{2,}')[1:5] AS t FROM l)
), f AS (SELECT doc_id, w, min(i * 100 + j) AS pos FROM w GROUP BY 1, 2
), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM f)
SELECT d.doc_id, coalesce(q, '') AS query FROM documents d LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY n) AS q FROM k WHERE n <= 15 GROUP BY 1) USING (doc_id)"""


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.col("text"), F.lit("\x07"), F.repeat(F.lit("`"), (F.col("turn") % 6).cast("int")))
    unsure = F.concat(F.col("text"), F.when(F.col("turn") == 3, " Could NOT find it").otherwise(""))
    return c.select("conv_id", "turn", T.fence(text).alias("fence"), F.sha2(T.strip_control(text), 256).alias("clean_sha"), T.any_of(unsure, T.UNCERTAIN).alias("unsure"), T.meaningful_tokens(F.col("text")).alias("tokens"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
FUNCTIONS_SQL = rf"""
SELECT conv_id, turn, repeat('`', greatest(3, turn % 6 + 1)::INTEGER) AS fence, sha256(text || repeat('`', (turn % 6)::INTEGER)) AS clean_sha, turn = 3 AS unsure,
  len(list_filter(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*'), lambda w: len(w) > 2 AND w NOT IN ({_STOP})))::BIGINT AS tokens FROM conversations"""


def leg_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second question's hits share with the third's, and what only one of them has."""
    hits = bm25_topk(spark, sf_dir)
    a, b = (hits.where(F.col("query_id") == q).select("id") for q in (2, 3))
    both = a.intersect(b).withColumn("found", F.lit("both"))
    return both.unionByName(a.subtract(b).withColumn("found", F.lit("second"))).unionByName(b.subtract(a).withColumn("found", F.lit("third")))


OVERLAP_SQL = f"""
WITH h AS ({_bm25_sql()}), a AS (SELECT id FROM h WHERE query_id = 2), b AS (SELECT id FROM h WHERE query_id = 3)
SELECT id, 'both' AS found FROM a WHERE id IN (SELECT id FROM b) UNION ALL SELECT id, 'second' FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'third' FROM b WHERE id NOT IN (SELECT id FROM a)"""

QUERIES = {
    "symbols_by_name": (symbols_by_name, BY_NAME_SQL),
    "top_symbols_per_file": (top_symbols_per_file, TOP_SQL),
    "path_fragments": (path_fragments, f"WITH {_FILES} SELECT file_id, rel_path, len(rel_path) AS length FROM f WHERE contains(lower(rel_path), 'dockerfile')"),
    "file_languages": (file_languages, LANGUAGES_SQL),
    "hydrated_hits": (hydrated_hits, HYDRATE_SQL),
    "community_context": (community_context, CONTEXT_SQL),
    "latest_definitions": (latest_definitions, LATEST_SQL),
    "hunk_identifiers": (hunk_identifiers, IDENTIFIERS_SQL),
    "text_functions": (text_functions, FUNCTIONS_SQL),
    "leg_overlap": (leg_overlap, OVERLAP_SQL),
}
