"""Queries on direct paths, further legs, merging and measuring them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.operators import legs, search
from seekframe.plans.lookups import _FILES, _files
from seekframe.plans.retrieval import _asked, _bm25_sql, _fields, _knn_sql, _vectors, bm25_topk, hybrid_search
from seekframe.plans.tables import SYMBOLS, part_symbols, table

HINTS = ["Dockerfile", "py", "json"]
_HINTS = "h(hint) AS (VALUES " + ", ".join(f"('{h}')" for h in HINTS) + ")"


def _hints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h,) for h in HINTS], "hint string")


def _in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order is a symbol of its part's file."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("file_id"), F.col("l_linenumber").cast("long").alias("line"), F.when(F.col("l_linenumber") == 1, "module").otherwise("function").alias("kind"))


_IN_FILES = "y AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS file_id, l_linenumber::BIGINT AS line, CASE WHEN l_linenumber = 1 THEN 'module' ELSE 'function' END AS kind FROM lineitem)"


def file_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legs.file_overview(_files(spark, sf_dir), _in_files(spark, sf_dir), _hints(spark))


FILE_SQL = f"""
WITH {_FILES}, {_IN_FILES}, {_HINTS}, c AS (SELECT DISTINCT file_id FROM (SELECT file_id, row_number() OVER (PARTITION BY hint ORDER BY length(rel_path), rel_path, file_id) AS n FROM f, h WHERE contains(lower(rel_path), lower(hint))) WHERE n <= 2
), r AS (SELECT file_id, id, row_number() OVER (PARTITION BY file_id ORDER BY line, id) AS rank FROM y JOIN c USING (file_id))
SELECT file_id, id, rank, round(1 - rank * 0.001::DOUBLE, 6) AS score FROM r"""


def project_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legs.project_overview(_files(spark, sf_dir), _in_files(spark, sf_dir))


PROJECT_SQL = f"""
WITH {_FILES}, {_IN_FILES}, r AS (SELECT id, CASE WHEN regexp_matches(lower(rel_path), '\\.md$') THEN 1 ELSE 4 END AS priority, row_number() OVER (ORDER BY CASE WHEN regexp_matches(lower(rel_path), '\\.md$') THEN 1 ELSE 4 END, rel_path, line, id) AS rank
  FROM y JOIN f USING (file_id) WHERE regexp_matches(lower(rel_path), '\\.md$') OR kind = 'module')
SELECT id, priority::INTEGER AS priority, rank, round(1 - rank * 0.001::DOUBLE, 6) AS score FROM r WHERE rank <= 40"""


def config_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legs.config_lookup(_files(spark, sf_dir), _hints(spark))


CONFIG_SQL = f"""
WITH {_FILES}, {_HINTS} SELECT hint, file_id FROM f, h WHERE contains(lower(rel_path), lower(hint)) AND (rel_path LIKE '%Dockerfile.prod' OR rel_path LIKE '%.JSON' OR rel_path LIKE '%.tf')"""


def import_path_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = part_symbols(spark, sf_dir).withColumn("line", F.col("id"))
    imports = symbols.select("grp", F.concat(F.lit("@shared/"), "qualified_name").alias("specifier"))
    return legs.import_path_seed(imports, symbols, spark.createDataFrame([("@shared/brand1",), ("brand2",)], "pattern string"))


SEED_SQL = f"""
WITH {SYMBOLS}, g AS (SELECT DISTINCT grp FROM sym WHERE contains('@shared/' || qualified_name, '@shared/brand1') OR contains(qualified_name, 'brand2')
), t AS (SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 WHEN 'method' THEN 2 ELSE 3 END, id) AS n FROM sym WHERE grp IN (SELECT grp FROM g)
), o AS (SELECT id, grp, row_number() OVER (ORDER BY grp, n) AS rank FROM t WHERE n <= 3)
SELECT id, grp, 0.3::DOUBLE AS score, rank FROM o WHERE rank <= 30"""


def file_summary_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is a file's summary; its text is the document of that id, if there is one, its symbols are two."""
    vectors = _vectors(spark, sf_dir).select(F.col("id").alias("file_id"), "v")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    symbols = vectors.select((F.col("file_id") * 2 + 1).alias("id"), "file_id", F.lit(9).alias("line")).unionByName(vectors.select((F.col("file_id") * 2).alias("id"), "file_id", (F.col("file_id") % 20).cast("int").alias("line")))
    return legs.file_summaries(vectors.join(texts, "file_id", "left"), symbols, _asked(spark, sf_dir), 20)


SUMMARY_LEG_SQL = f"SELECT query_id, id AS file_id, CASE WHEN id % 20 <= 9 THEN id * 2 ELSE id * 2 + 1 END AS id, score, rank FROM ({_knn_sql('l2_inverse')}) WHERE id IN (SELECT doc_id FROM documents WHERE text <> '')"


def sub_chunk_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors in a row are the parts of one symbol."""
    parts = _vectors(spark, sf_dir).select(F.col("id").alias("part_id"), F.floor(F.col("id") / 3).alias("id"), "v")
    return legs.sub_chunks(parts, _asked(spark, sf_dir), 20)


SUB_SQL = f"SELECT query_id, id AS part_id, id // 3 AS id, score, rank FROM ({_knn_sql('l2_inverse')})"

QUERIES_ASKED = [(1, "released under the MIT License"), (2, "tion erin")]
EXPANDED = [(1, 1, " public license "), (1, 2, ""), (1, 3, "released under the MIT License"), (1, 4, "apache license"), (2, 1, "thon reti")]


def multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded variants of two queries, all searched at once, their hits merged."""
    from seekframe.functions import text as T

    asked = spark.createDataFrame(QUERIES_ASKED, "query_id bigint, query string")
    all_ = legs.variants(asked, spark.createDataFrame(EXPANDED, "query_id bigint, place bigint, query string"), 3)
    numbered = all_.select((F.col("query_id") * 10 + F.col("place")).alias("query_id"), T.query_terms(F.col("query")).alias("terms"))
    hits = search.bm25(table(spark, sf_dir, "documents"), numbered, _fields())
    return legs.merge_variants(hits.select(F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10).alias("place"), "id", "score", "rank"), 20)


_VARIANT_TERMS = "q(query_id, terms) AS (VALUES (10, ['released', 'under', 'mit', 'license']), (11, ['public', 'license']), (13, ['apache', 'license']), (20, ['tion', 'erin']), (21, ['thon', 'reti']))"
MULTI_SQL = f"""
WITH b AS ({_bm25_sql(terms=_VARIANT_TERMS)}), n AS (SELECT query_id // 10 AS query_id, query_id % 10 AS place, id, score, rank AS was, row_number() OVER (PARTITION BY query_id // 10, id ORDER BY score DESC, query_id % 10, rank) AS n FROM b
), k AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, was, id) AS rank FROM n WHERE n = 1)
SELECT * FROM k WHERE rank <= 20"""


def rerank_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded scores of two questions: short documents first; the third question has none."""
    hits = bm25_topk(spark, sf_dir).select("query_id", "id", "score", "rank")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    recorded = hits.where("query_id <> 3").join(docs, "id").where("n_chars % 3 <> 0").select("query_id", "id", F.round(1000.0 / (F.col("n_chars") + 1), 6).alias("score"))
    return legs.rerank(hits, recorded, 15)


RERANK_SQL = f"""
WITH b AS ({_bm25_sql()}), r AS (SELECT query_id, id, b.score, b.rank AS was, CASE WHEN query_id <> 3 AND n_chars % 3 <> 0 THEN round(1000::DOUBLE / (n_chars + 1), 6) END AS again FROM b JOIN documents ON doc_id = id
), h AS (SELECT *, count(again) OVER (PARTITION BY query_id) > 0 AS has FROM r
), s AS (SELECT query_id, id, CASE WHEN has THEN again ELSE score END AS score, CASE WHEN has THEN 'reranked' ELSE 'kept' END AS outcome,
  row_number() OVER (PARTITION BY query_id ORDER BY again DESC NULLS LAST, was, id) AS rank FROM h)
SELECT query_id, id, score, rank, outcome FROM s WHERE rank <= 15"""


def metrics_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "lang", "source", F.concat("doc_id", F.lit(".md"))).alias("rel_path"))
    found = hybrid_search(spark, sf_dir).join(paths, "id").select("query_id", "rank", "rel_path")
    return legs.by_path(found, spark.createDataFrame([(1, "src1"), (2, "fr/"), (3, "nowhere")], "query_id bigint, piece string"))


def _by_path_sql() -> str:
    from seekframe.plans.retrieval import _rrf_sql

    return f"""
WITH x(query_id, piece) AS (VALUES (1, 'src1'), (2, 'fr/'), (3, 'nowhere')), h AS ({_rrf_sql()}
), p AS (SELECT x.query_id::BIGINT AS query_id, (SELECT min(rank) FROM h JOIN documents ON doc_id = id WHERE h.query_id = x.query_id AND contains(documents.lang || '/' || documents.source || '/' || doc_id || '.md', piece)) AS place FROM x)
SELECT query_id, coalesce(place, -1)::BIGINT AS place, coalesce((place <= 1)::INTEGER, 0)::DOUBLE AS recall_1, coalesce((place <= 5)::INTEGER, 0)::DOUBLE AS recall_5, coalesce((place <= 10)::INTEGER, 0)::DOUBLE AS recall_k,
  round(coalesce(1 / place::DOUBLE, 0), 6) AS mrr, round(coalesce(CASE WHEN place <= 10 THEN 1 / log2(place + 1::DOUBLE) END, 0), 6) AS ndcg FROM p"""


def next_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legs.next_turn(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn"))


def settings_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of the settings of an index: nations with their regions, before and after some changed."""
    n = table(spark, sf_dir, "nation")
    one = n.where("n_nationkey % 7 <> 0").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    other = n.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 2 == 0, "x").otherwise(F.col("n_regionkey").cast("string")).alias("value"))
    return legs.settings_differ(one, other)


SETTINGS_SQL = """
WITH a AS (SELECT n_name AS key, n_regionkey::VARCHAR AS was FROM nation WHERE n_nationkey % 7 <> 0), b AS (SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'x' ELSE n_regionkey::VARCHAR END AS now FROM nation WHERE n_nationkey % 5 <> 0)
SELECT key, was, now FROM a FULL JOIN b USING (key) WHERE was IS DISTINCT FROM now"""


def cross_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands are repositories; a call is resolved if one other brand has the name."""
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("repo"), F.concat_ws("_", F.regexp_replace("p_name", " ", "_"), F.col("p_partkey") % 307).alias("name"))
    return legs.cross_repository(s.select(F.col("id").alias("call_id"), "repo", "name"), s)


CROSS_SQL = """
WITH s AS (SELECT p_partkey AS id, p_brand AS repo, replace(p_name, ' ', '_') || '_' || p_partkey % 307 AS name FROM part)
SELECT c.id AS call_id, min(s.repo) AS repo, min(s.id) AS id FROM s c JOIN s ON s.name = c.name AND s.repo <> c.repo GROUP BY c.id HAVING count(*) = 1"""

QUERIES = {
    "file_overview": (file_overview, FILE_SQL),
    "project_overview": (project_overview, PROJECT_SQL),
    "config_lookup": (config_lookup, CONFIG_SQL),
    "import_path_seed": (import_path_seed, SEED_SQL),
    "file_summary_leg": (file_summary_leg, SUMMARY_LEG_SQL),
    "sub_chunk_leg": (sub_chunk_leg, SUB_SQL),
    "multi_query": (multi_query, MULTI_SQL),
    "rerank_recorded": (rerank_recorded, RERANK_SQL),
    "metrics_by_path": (metrics_by_path, _by_path_sql()),
    "next_turns": (next_turns, "SELECT conv_id AS session, max(turn) + 1 AS turn FROM conversations GROUP BY 1"),
    "settings_differ": (settings_differ, SETTINGS_SQL),
    "cross_repository": (cross_repository, CROSS_SQL),
}
