"""Queries on ranked retrieval and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.functions import text as T
from seekframe.operators import fusion, routing, search
from seekframe.plans.tables import table

QUESTIONS = [(1, "released under the MIT License"), (2, "tion erin"), (3, "thon reti")]
TERMS = "q(query_id, terms) AS (VALUES (1, ['released', 'under', 'mit', 'license']), (2, ['tion', 'erin']), (3, ['thon', 'reti']))"
PATTERNS = [(1, "The "), (2, "erin"), (3, "MIT License")]
GREP_Q = "p(query_id, pattern) AS (VALUES (1, 'The '), (2, 'erin'), (3, 'MIT License'))"
DECLARED = 2.0


def questions(spark: SparkSession) -> DataFrame:
    asked = spark.createDataFrame(QUESTIONS, "query_id bigint, query string")
    return asked.select("query_id", T.query_terms(F.col("query")).alias("terms"))


def patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATTERNS, "query_id bigint, pattern string")


def _fields(declared: float = 1.0) -> dict:
    return {"name": (T.first_line(F.col("text")), declared), "body": (F.col("text"), 1.0)}


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), questions(spark), _fields())


def bm25_declaration_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), questions(spark), _fields(DECLARED))


def bm25_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), questions(spark), _fields(), keep=F.startswith(F.col("source"), F.lit("src1")))


def bm25_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(1, ["licen"]), (2, ["thoner"])], "query_id bigint, terms array<string>")
    return search.bm25(table(spark, sf_dir, "documents"), asked, _fields(), prefix=True)


def _bm25_sql(declared: float = 1.0, keep: str = "true", prefix: bool = False, terms: str = TERMS) -> str:
    on = "starts_with(word, term)" if prefix else "word = term"
    return f"""
WITH {terms}, t AS (
  SELECT doc_id AS id, {keep} AS keep, regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z_][a-z0-9_]*') AS a, regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*') AS b FROM documents
), s AS (SELECT count(*) AS n_docs, avg(len(a) + len(b)) AS mean_length FROM t
), h AS (SELECT id, keep, len(a) + len(b) AS length, unnest(a) AS word, {declared}::DOUBLE AS w FROM t UNION ALL SELECT id, keep, len(a) + len(b), unnest(b), 1::DOUBLE FROM t
), c AS (SELECT query_id, term, id, keep, length, sum(w) AS f FROM h JOIN (SELECT query_id, unnest(terms) AS term FROM q) ON {on} GROUP BY ALL
), n AS (SELECT *, count(*) OVER (PARTITION BY query_id, term) AS n FROM c
), r AS (
  SELECT query_id, id, round(sum(greatest(1e-6, ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE))) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length))), 6) AS score, count(*) AS met
  FROM n, s WHERE keep GROUP BY 1, 2
), k AS (SELECT query_id::BIGINT AS query_id, id, score, round(1 / (1 + score), 6) AS shown, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r JOIN q USING (query_id) WHERE met = len(terms))
SELECT * FROM k WHERE rank <= 20"""


def _grep(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return search.grep(table(spark, sf_dir, "documents"), patterns(spark), T.first_line(F.col("text")), F.col("text"), k)


def grep_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "^Released under"), (2, "[0-9]{3}\\.[0-9]+\\.[0-9]+")], "query_id bigint, pattern string")
    return search.grep(table(spark, sf_dir, "documents"), asked, T.first_line(F.col("text")), F.col("text"), 50, regex=True)


_GREP_ROWS = f"""{GREP_Q}, g AS (
  SELECT query_id::BIGINT AS query_id, doc_id AS id, CASE WHEN starts_with(lower(split_part(text, chr(10), 1)), lower(pattern)) THEN 1::DOUBLE WHEN contains(text, pattern) THEN 0.8::DOUBLE END AS score FROM documents, p
), gk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM g WHERE score IS NOT NULL)"""
GREP_SQL = f"WITH {_GREP_ROWS} SELECT * FROM gk WHERE rank <= 10"
GREP_REGEX_SQL = """
WITH p(query_id, pattern) AS (VALUES (1, '^Released under'), (2, '[0-9]{3}\\.[0-9]+\\.[0-9]+'))
SELECT * FROM (SELECT query_id::BIGINT AS query_id, doc_id AS id, 0.8::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank
  FROM documents, p WHERE regexp_matches(text, '(?m)' || pattern)) WHERE rank <= 50"""


def sparse_dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = search.sparse_weights(table(spark, sf_dir, "documents"), F.col("text"))
    asked = questions(spark).select("query_id", F.explode("terms").alias("token"), F.lit(1.5).alias("weight"))
    return search.sparse_dot(weights, asked)


SPARSE_SQL = f"""
WITH {TERMS}, t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')) AS token FROM documents
), c AS (SELECT id, token, count(*) AS tf FROM t GROUP BY ALL
), w AS (SELECT id, token, round(ln(1 + tf::DOUBLE), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tf DESC, token) AS n FROM c) WHERE n <= 128
), s AS (SELECT query_id::BIGINT AS query_id, id, round(sum(weight * 1.5::DOUBLE), 6) AS score FROM w JOIN (SELECT query_id, unnest(terms) AS token FROM q) USING (token) GROUP BY ALL
), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 20"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q"))


def _knn(metric: str, label: int | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        keep = None if label is None else F.col("label") == label
        return search.knn(_vectors(spark, sf_dir), _asked(spark, sf_dir), 20, metric, keep=keep)

    return query


def _knn_sql(metric: str, label: int | None = None) -> str:
    where = "true" if label is None else f"a.label = {label}"
    pair = f"FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 AND {where}"
    if metric == "cosine":
        rows = f"SELECT b.vec_id AS query_id, a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score {pair}"
        return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({rows})) WHERE rank <= 20"
    score = "greatest(0::DOUBLE, 1 - distance)" if metric == "l2" else "1 / (1 + distance)"
    rows = f"SELECT b.vec_id AS query_id, a.vec_id AS id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance {pair}"
    return f"SELECT * FROM (SELECT *, round({score}, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ({rows})) WHERE rank <= 20"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.lists(("bm25", bm25_topk(spark, sf_dir)), ("grep", _grep(spark, sf_dir)))


_HITS_SQL = f"""WITH b AS ({_bm25_sql()}), g AS ({GREP_SQL}), h AS (
  SELECT query_id, 0::BIGINT AS list_idx, 'bm25' AS source, rank AS pos, id, score FROM b UNION ALL SELECT query_id, 1, 'grep', rank, id, score FROM g)"""


def _rrf_sql(weights: str = "1::DOUBLE", lang: str = "1::DOUBLE", limit: int = 10) -> str:
    return f"""{_HITS_SQL}, f AS (
  SELECT query_id, h.id, sum({weights} / (60 + pos)) AS raw, max({lang}) AS lw, min([list_idx, pos]) AS first FROM h JOIN documents d ON d.doc_id = h.id GROUP BY ALL
), r AS (SELECT query_id, id, round(raw * lw, 9) AS score, first FROM f
), o AS (SELECT query_id, id, score, CASE first[1] WHEN 0 THEN 'bm25' ELSE 'grep' END AS source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first[1], first[2], id) AS rank FROM r)
SELECT * FROM o WHERE rank <= {limit}"""


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and exact matches, fused by reciprocal ranks."""
    return fusion.rrf(_hits(spark, sf_dir), limit=10)


def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(_hits(spark, sf_dir), leg_weights={"bm25": 1.0, "grep": 0.25}, limit=10)


def rrf_lang_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    return fusion.rrf(hits, language=F.col("lang"), language_weights={"fr": 0.5, "de": 0.4, "es": 0.3}, limit=10)


def rrf_federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language is a repository with its own list; their lists are fused by repository weights."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    registry = spark.createDataFrame([("de", 0, 1.0), ("en", 1, 2.0), ("es", 2, 1.0), ("fr", 3, 1.0)], "alias string, list_idx bigint, weight double")
    return fusion.federated(bm25_topk(spark, sf_dir).join(docs, "id").withColumnRenamed("lang", "alias"), registry, "bm25", limit=10)


RRF_FEDERATED_SQL = f"""
WITH b AS ({_bm25_sql()}), h AS (SELECT query_id, d.lang, list_position(['de', 'en', 'es', 'fr'], d.lang) - 1 AS list_idx, rank AS pos, id FROM b JOIN documents d ON d.doc_id = b.id
), r AS (SELECT query_id, id, round(CASE lang WHEN 'en' THEN 2::DOUBLE ELSE 1::DOUBLE END / (60 + pos), 9) AS score, lang || ':bm25' AS source, list_idx, pos FROM h
), o AS (SELECT query_id, id, score, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list_idx, pos, id) AS rank FROM r)
SELECT * FROM o WHERE rank <= 10"""


def dedup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.dedup_best(_hits(spark, sf_dir)).select("query_id", "id", "source", "score")


DEDUP_SQL = f"{_HITS_SQL} SELECT query_id, id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, list_idx, pos) AS n FROM h) WHERE n = 1"


def xtr_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label is a document, each vector of it a token; every twentieth vector is a token of one of two queries."""
    asked = _asked(spark, sf_dir)
    hits = search.knn(_vectors(spark, sf_dir), asked, 20, "cosine").join(_vectors(spark, sf_dir).select("id", F.col("label").cast("bigint").alias("label")), "id")
    query = F.floor(F.col("query_id") / 20) % 2
    scores = hits.select(query.alias("query_id"), F.col("query_id").alias("token"), F.col("label").alias("id"), "score")
    return fusion.xtr(scores, asked.select(query.alias("query_id"), F.col("query_id").alias("token")), 0.1)


XTR_SQL = f"""
WITH h AS ({_knn_sql("cosine")}), s AS (SELECT query_id // 20 % 2 AS query_id, query_id AS token, e.label::BIGINT AS id, max(score) AS best FROM h JOIN embeddings e ON e.vec_id = h.id GROUP BY ALL
), n AS (SELECT vec_id // 20 % 2 AS query_id, count(*) AS tokens FROM embeddings WHERE vec_id % 20 = 0 GROUP BY 1)
SELECT s.query_id, id, round((sum(best) + (tokens - count(*)) * 0.1::DOUBLE) / tokens, 6) AS score FROM s JOIN n USING (query_id) GROUP BY s.query_id, id, tokens"""


def pagerank_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's centrality is its length here; the ten longest are boosted."""
    central = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("centrality"))
    return fusion.boost(hybrid_search(spark, sf_dir), central, 1.3, 100)


BOOST_SQL = f"""
WITH hs AS ({_rrf_sql()}), c AS (SELECT doc_id AS id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100
), b AS (SELECT query_id, id, round(CASE WHEN id IN (SELECT id FROM c) THEN score * 1.3::DOUBLE ELSE score END, 9) AS score, rank FROM hs)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, id) AS rank FROM b"""


def breadth_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    narrow = bm25_topk(spark, sf_dir).where("rank <= 1").select("query_id", "id").join(docs, "id").select("query_id", "id", "source")
    wide = _grep(spark, sf_dir).select("query_id", "id").join(docs, "id").select("query_id", "id", "source")
    return fusion.breadth_floor(narrow, wide, "source")


FLOOR_SQL = f"""
WITH b AS ({_bm25_sql()}), g AS ({GREP_SQL}), n AS (SELECT query_id, id, source FROM b JOIN documents ON doc_id = id WHERE rank <= 1
), s AS (SELECT query_id, count(DISTINCT source) AS groups, count(*) AS n FROM n GROUP BY 1
), w AS (SELECT g.query_id, id, source FROM g JOIN documents ON doc_id = id LEFT JOIN s ON s.query_id = g.query_id WHERE coalesce(groups < 2, true) AND coalesce(n < 10, true))
SELECT *, false AS extra FROM n UNION ALL SELECT *, true FROM w WHERE (query_id, id) NOT IN (SELECT query_id, id FROM n)"""


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.page(hybrid_search(spark, sf_dir), 3, 4)


PAGED_SQL = f"WITH r AS ({_rrf_sql()}) SELECT query_id, id, score, source, rank, CASE WHEN total > 7 THEN 7::BIGINT END AS next_cursor FROM (SELECT *, max(rank) OVER (PARTITION BY query_id) AS total FROM r) WHERE rank > 3 AND rank <= 7"


def router(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    extra = spark.createDataFrame([(-1, "what is strix?"), (-2, "walk me through indexing"), (-3, "how does auth work"), (-4, "list all users")], "query_id bigint, query string")
    return routing.route(asked.unionByName(extra))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
ROUTER_SQL = f"""
WITH q AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT * FROM (VALUES (-1, 'what is strix?'), (-2, 'walk me through indexing'), (-3, 'how does auth work'), (-4, 'list all users'))
), t AS (SELECT *, len(list_filter(regexp_extract_all(lower(query), '[a-z_][a-z0-9_]*'), lambda w: len(w) > 2 AND w NOT IN ({_STOP})))::BIGINT AS tokens FROM q)
SELECT query_id, CASE
  WHEN regexp_matches(trim(query), '(?i)^what (is|are) \\w+\\??$') OR regexp_matches(trim(query), '(?i)^(list|show) all ') OR regexp_matches(trim(query), '(?i)^define ') THEN 1
  WHEN contains(lower(query), 'from ... to ...') OR contains(lower(query), 'end-to-end') OR contains(lower(query), 'step by step') OR contains(lower(query), 'walk me through') OR contains(lower(query), 'full flow')
    OR len(query) > 80 AND len(regexp_extract_all(lower(query), ' and ')) >= 2 THEN 3 ELSE 2 END::BIGINT AS tier, tokens, tokens <= 5 AS lexical_only FROM t"""


def intent_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    intents = ["symbol_lookup", "comparison", "blast_radius", "nonsense", "dependency_map"]
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.element_at(F.array(*[F.lit(i) for i in intents]), (F.col("item_id") % 5 + 1).cast("int")).alias("intent"))
    return routing.planned(asked).select("query_id", "intent", "legs", F.col("import_max_extra").cast("bigint").alias("import_max_extra"), "assembly", "compression_ratio")


PLANS_SQL = """
WITH s(intent, legs, import_max_extra, assembly, compression_ratio) AS (VALUES ('symbol_lookup', 'grep,bm25,vector', 3, 'greedy', 1.0::DOUBLE), ('comparison', 'vector,bm25,grep', 8, 'greedy', 0.65),
  ('blast_radius', 'grep,vector,bm25', 30, 'breadth_first', 0.3), ('dependency_map', 'vector,bm25', 20, 'breadth_first', 0.3))
SELECT item_id AS query_id, intent, legs, import_max_extra::BIGINT AS import_max_extra, assembly, compression_ratio
FROM (SELECT item_id, ['symbol_lookup', 'comparison', 'blast_radius', 'symbol_lookup', 'dependency_map'][item_id % 5 + 1] AS intent FROM benchmark) JOIN s USING (intent)"""

QUERIES = {
    "hybrid_search": (hybrid_search, _rrf_sql()),
    "bm25_topk": (bm25_topk, _bm25_sql()),
    "bm25_declaration_boost": (bm25_declaration_boost, _bm25_sql(DECLARED)),
    "bm25_path_filter": (bm25_path_filter, _bm25_sql(keep="starts_with(source, 'src1')")),
    "bm25_prefix": (bm25_prefix, _bm25_sql(prefix=True, terms="q(query_id, terms) AS (VALUES (1, ['licen']), (2, ['thoner']))")),
    "grep_names_and_bodies": (_grep, GREP_SQL),
    "grep_regex": (grep_regex, GREP_REGEX_SQL),
    "sparse_dot_topk": (sparse_dot_topk, SPARSE_SQL),
    "knn_l2_topk": (_knn("l2"), _knn_sql("l2")),
    "knn_inverse_score": (_knn("l2_inverse"), _knn_sql("l2_inverse")),
    "knn_cosine_topk": (_knn("cosine"), _knn_sql("cosine")),
    "knn_label_filtered": (_knn("l2", 3), _knn_sql("l2", 3)),
    "rrf_weighted": (rrf_weighted, _rrf_sql("CASE source WHEN 'grep' THEN 0.25::DOUBLE ELSE 1::DOUBLE END".replace("source", "h.source"))),
    "rrf_lang_weighted": (rrf_lang_weighted, _rrf_sql(lang="CASE d.lang WHEN 'fr' THEN 0.5::DOUBLE WHEN 'de' THEN 0.4 WHEN 'es' THEN 0.3 ELSE 1 END")),
    "rrf_federated": (rrf_federated, RRF_FEDERATED_SQL),
    "dedup_keep_best": (dedup_keep_best, DEDUP_SQL),
    "xtr_score": (xtr_score, XTR_SQL),
    "pagerank_boost": (pagerank_boost, BOOST_SQL),
    "breadth_floor": (breadth_floor, FLOOR_SQL),
    "pagination": (paged, PAGED_SQL),
    "query_router": (router, ROUTER_SQL),
    "intent_plans": (intent_plans, PLANS_SQL),
}
