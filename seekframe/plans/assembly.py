"""Queries on structuring texts and packing contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.functions import text as T
from seekframe.operators import fusion, packing, structure
from seekframe.plans.retrieval import _hits, _rrf_sql, bm25_topk
from seekframe.plans.tables import table

_WORDS = r"len(regexp_extract_all({}, '[^ \t\r\n]+'))::BIGINT"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the legs found for each question, fused: query_id, source, id, rank, score, tokens.  A list is no longer than the legs' k together."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("source"), T.words(F.col("text")).alias("tokens"))
    return fusion.rrf(_hits(spark, sf_dir)).select("query_id", "id", "rank", "score").join(docs, "id")


_RANKED = f"""r AS (SELECT x.query_id, d.lang AS source, x.id, x.rank, x.score, {_WORDS.format("d.text")} AS tokens FROM ({_rrf_sql(limit=1000)}) x JOIN documents d ON d.doc_id = x.id)"""

BUDGET = 1500


def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.greedy(_ranked(spark, sf_dir), BUDGET)


GREEDY_SQL = f"""
WITH RECURSIVE {_RANKED}, g AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS used, NULL::BIGINT AS id, 0::BIGINT AS tokens, false AS took FROM (SELECT DISTINCT query_id FROM r)
  UNION ALL SELECT r.query_id, r.rank, CASE WHEN used + r.tokens <= {BUDGET} THEN used + r.tokens ELSE used END, r.id, r.tokens, used + r.tokens <= {BUDGET} FROM g JOIN r ON r.query_id = g.query_id AND r.rank = g.rank + 1)
SELECT query_id, id, rank, tokens FROM g WHERE took"""


def proportional_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.proportional(_ranked(spark, sf_dir), BUDGET)


PROPORTIONAL_SQL = f"""
WITH RECURSIVE {_RANKED}, s AS (SELECT query_id, source, round_even({BUDGET}::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY query_id), 0)::BIGINT AS slice FROM r GROUP BY 1, 2
), o AS (SELECT r.*, slice, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM r JOIN s USING (query_id, source)
), g AS (SELECT query_id, source, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS id, 0::BIGINT AS rank, 0::BIGINT AS tokens, false AS took FROM s
  UNION ALL SELECT o.query_id, o.source, o.n, CASE WHEN used + o.tokens <= slice THEN used + o.tokens ELSE used END, o.id, o.rank, o.tokens, used + o.tokens <= slice FROM g JOIN o ON o.query_id = g.query_id AND o.source = g.source AND o.n = g.n + 1
), f AS (SELECT * FROM g WHERE n > 0), u AS (SELECT query_id, coalesce(sum(CASE WHEN took THEN tokens END), 0)::BIGINT AS used FROM f GROUP BY 1
), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS m FROM f WHERE NOT took
), h AS (SELECT query_id, 0::BIGINT AS m, used, NULL::BIGINT AS id, 0::BIGINT AS rank, 0::BIGINT AS tokens, false AS took FROM u
  UNION ALL SELECT p.query_id, p.m, CASE WHEN h.used + p.tokens <= {BUDGET} THEN h.used + p.tokens ELSE h.used END, p.id, p.rank, p.tokens, h.used + p.tokens <= {BUDGET} FROM h JOIN p ON p.query_id = h.query_id AND p.m = h.m + 1)
SELECT query_id, id, rank, tokens FROM f WHERE took UNION ALL SELECT query_id, id, rank, tokens FROM h WHERE took"""


def breadth_first_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.breadth_first(_ranked(spark, sf_dir).withColumnRenamed("source", "grp"), BUDGET)


BREADTH_SQL = f"""
WITH RECURSIVE {_RANKED}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, rank) AS i FROM r
), b AS (SELECT query_id, id, tokens, i, max(score) OVER (PARTITION BY query_id, source) AS best, min(rank) OVER (PARTITION BY query_id, source) AS first FROM k WHERE i <= 2
), o AS (SELECT query_id, id, tokens, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first, i) AS rank FROM b
), g AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS used, NULL::BIGINT AS id, 0::BIGINT AS tokens, false AS took FROM (SELECT DISTINCT query_id FROM o)
  UNION ALL SELECT o.query_id, o.rank, CASE WHEN used + o.tokens <= {BUDGET} THEN used + o.tokens ELSE used END, o.id, o.tokens, used + o.tokens <= {BUDGET} FROM g JOIN o ON o.query_id = g.query_id AND o.rank = g.rank + 1)
SELECT query_id, id, rank, tokens FROM g WHERE took"""


def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in pages of a source: those whose ids share all but the last three digits."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("source").alias("grp"), F.floor(F.col("doc_id") / 1000).alias("page"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), T.words(F.col("text")).alias("tokens"))
    return packing.batches(rows, 2000, "grp", "page")


BATCHES_SQL = f"""
WITH RECURSIVE r AS (SELECT source AS grp, doc_id // 1000 AS page, doc_id AS id, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) AS rank, {_WORDS.format("text")} AS tokens FROM documents
), g AS (SELECT grp, page, rank, id, tokens AS used, 0::BIGINT AS batch FROM r WHERE rank = 1
  UNION ALL SELECT g.grp, g.page, r.rank, r.id, CASE WHEN used > 0 AND used + r.tokens > 2000 THEN r.tokens ELSE used + r.tokens END, CASE WHEN used > 0 AND used + r.tokens > 2000 THEN batch + 1 ELSE batch END FROM g JOIN r ON r.grp = g.grp AND r.page = g.page AND r.rank = g.rank + 1)
SELECT grp, page, id, batch FROM g"""


def context_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of all hits with their whole texts; its digest, as it is long."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.col("text").alias("body"), (F.col("n_chars") % 100).alias("line_start"), (F.col("n_chars") % 100 + 7).alias("line_end"), F.concat(F.lit("doc"), "doc_id").alias("name"))
    return packing.context(bm25_topk(spark, sf_dir).join(docs, "id")).select("query_id", F.length("context").cast("bigint").alias("length"), F.sha2("context", 256).alias("context_sha"))


def context_sql(bm25_sql: str) -> str:
    return f"""
WITH b AS ({bm25_sql}), t AS (SELECT query_id, source AS path, rank, n_chars % 100 AS s, '[Lines ' || n_chars % 100 || '-' || (n_chars % 100 + 7) || '] doc' || doc_id || chr(10) || text AS piece FROM b JOIN documents ON doc_id = id
), f AS (SELECT query_id, path, min(rank) AS first, '=== ' || path || ' ===' || chr(10) || string_agg(piece, chr(10) || chr(10) ORDER BY s, rank) AS text FROM t GROUP BY 1, 2
), c AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY first) AS context FROM f GROUP BY 1)
SELECT query_id, length(context) AS length, sha256(context) AS context_sha FROM c"""


def history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return packing.history(c.select(F.col("conv_id").alias("conv"), "turn", T.words(F.col("text")).alias("tokens")), 150).select("conv", "turn", "tokens")


HISTORY_SQL = f"""
SELECT conv, turn, tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv ORDER BY turn DESC) AS so_far, row_number() OVER (PARTITION BY conv ORDER BY turn DESC) AS n FROM (SELECT conv_id AS conv, turn, {_WORDS.format("text")} AS tokens FROM conversations)) WHERE so_far <= 150 OR n = 1"""


def lexical_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = T.word_set(F.lit("the erin tion and license"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.posexplode(packing.segments(F.regexp_replace("text", "\n", "\n\n"))).alias("pos", "part"))
    return d.select("id", F.col("pos").cast("bigint").alias("pos"), packing.lexical_density(asked, T.word_set(F.col("part"))).alias("density"))


COMPRESSION_SQL = r"""
WITH p AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n[ \t]*\n+'), lambda s: trim(s) <> '') AS parts FROM documents
), x AS (SELECT id, unnest(range(len(parts))) AS pos, unnest(parts) AS part FROM p
), w AS (SELECT id, pos, list_distinct(regexp_extract_all(lower(part), '[a-z0-9_]+')) AS s FROM x
), d AS (SELECT id, pos, round(len(list_intersect(s, ['the', 'erin', 'tion', 'and', 'license'])) / sqrt(len(s) + 1), 6) AS density FROM w)
SELECT * FROM d"""


def compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return packing.compress(units, T.word_set(F.lit("the erin tion and license")), 0.3)


def chunk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = T.chunk_text(F.col("source"), F.col("lang"), F.lit("module"), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.when(F.col("doc_id") % 3 == 0, T.first_line(F.col("text"))), F.col("text"))
    return d.select("doc_id", F.sha2(text, 256).alias("chunk_sha"), T.words(text).alias("tokens"))


HEADERS_SQL = rf"""
WITH c AS (SELECT doc_id, concat_ws(chr(10), '# File: ' || source || ' | Language: ' || lang, CASE WHEN doc_id % 2 = 0 THEN '# Module: ' || source END, '',
  CASE WHEN doc_id % 3 = 0 AND NOT regexp_matches(text, '^\s*["'']') THEN '# Doc: ' || split_part(text, chr(10), 1) END, text) AS chunk FROM documents)
SELECT doc_id, sha256(chunk) AS chunk_sha, {_WORDS.format("chunk")} AS tokens FROM c"""


def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.line_windows(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 10).select("id", "name", "line_start", "line_end", F.sha2("body", 256).alias("body_sha"))


WINDOWS_SQL = r"""
WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS lines FROM documents
), w AS (SELECT id, lines, unnest(range(0, len(lines), 10)) AS a FROM l
), b AS (SELECT id, a + 1 AS line_start, least(a + 10, len(lines)) AS line_end, array_to_string(lines[a + 1:a + 10], chr(10)) AS body FROM w)
SELECT id, 'section_' || row_number() OVER (PARTITION BY id ORDER BY line_start) AS name, line_start, line_end, sha256(body) AS body_sha FROM b WHERE regexp_matches(body, '[^ \t\r\n\x0B\f]')"""


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every fourth line a heading of level 1 to 3."""
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.repeat(F.lit("#"), (i % 3 + 1).cast("int")), F.lit(" h"), i.cast("string"))).otherwise(F.regexp_replace(x, "^#+", "")))
    return structure.markdown_sections(d.select(F.col("doc_id").alias("id"), F.array_join(lines, "\n").alias("text"))).select("id", "title", "level", "path", "line_start", "line_end")


MARKDOWN_SQL = """
WITH h AS (SELECT doc_id AS id, len(string_split(text, chr(10))) AS n, unnest(range(0, len(string_split(text, chr(10))), 4)) AS i FROM documents
), t AS (SELECT id, n, i, i % 3 + 1 AS level, 'h' || i AS title FROM h
), p AS (SELECT a.id, a.i, a.n, a.level, a.title, (SELECT min(b.i) FROM t b WHERE b.id = a.id AND b.i > a.i AND b.level <= a.level) AS nxt,
  (SELECT max(b.i) FROM t b WHERE b.id = a.id AND b.i < a.i AND b.level = 1) AS p1, (SELECT max(b.i) FROM t b WHERE b.id = a.id AND b.i < a.i AND b.level = 2) AS p2 FROM t a)
SELECT id, title, level::BIGINT AS level, CASE WHEN level = 1 THEN title
  WHEN level = 2 THEN concat_ws(' > ', 'h' || p1, title)
  ELSE concat_ws(' > ', 'h' || p1, CASE WHEN p2 > coalesce(p1, -1) THEN 'h' || p2 END, title) END AS path, i + 1 AS line_start, coalesce(nxt, n)::BIGINT AS line_end FROM p"""


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.html_links(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html"))


LINKS_SQL = """SELECT page_id AS id, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::BIGINT AS links, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages"""


def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seekframe.sources import diffs

    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("+++ b/"), "source", F.lit("\n@@ -1,2 +3 @@ f\n context\n-old "), T.first_line(F.col("text")), F.lit("\n+new one\n@@ -9 +9,4 @@\n+"), F.col("lang"), F.lit("\n"))
    return diffs.hunks(d.select(F.col("doc_id").alias("id"), text.alias("text")))


DIFF_SQL = """
WITH d AS (SELECT doc_id AS id, source AS file, split_part(text, chr(10), 1) AS l, lang FROM documents)
SELECT id, file, 1::BIGINT AS hunk, 1::BIGINT AS old_start, 2::BIGINT AS old_count, 3::BIGINT AS new_start, 1::BIGINT AS new_count, 'new one' AS added, 'old ' || l AS removed FROM d
UNION ALL SELECT id, file, 2, 9, 1, 9, 4, lang, '' FROM d"""


def fused_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).groupBy("query_id").agg(F.count(F.when(F.col("source") == "bm25", 1)).alias("bm25"), F.count(F.when(F.col("source") == "grep", 1)).alias("grep"), F.countDistinct("id").alias("ids"))


def _sources_sql() -> str:
    from seekframe.plans.retrieval import _HITS_SQL

    return f"{_HITS_SQL} SELECT query_id, count(*) FILTER (source = 'bm25') AS bm25, count(*) FILTER (source = 'grep') AS grep, count(DISTINCT id) AS ids FROM h GROUP BY 1"


def _context_sql() -> str:
    from seekframe.plans.retrieval import _bm25_sql

    return context_sql(_bm25_sql())


QUERIES = {
    "greedy_pack": (greedy_pack, GREEDY_SQL),
    "proportional_pack": (proportional_pack, PROPORTIONAL_SQL),
    "breadth_first_pack": (breadth_first_pack, BREADTH_SQL),
    "token_batches": (token_batches, BATCHES_SQL),
    "context_format": (context_format, _context_sql()),
    "history_trim": (history_trim, HISTORY_SQL),
    "lexical_compression": (lexical_compression, COMPRESSION_SQL),
    "compressed_units": (compressed, None),
    "chunk_headers": (chunk_headers, HEADERS_SQL),
    "line_windows": (line_windows, WINDOWS_SQL),
    "markdown_sections": (markdown_sections, MARKDOWN_SQL),
    "html_links": (html_links, LINKS_SQL),
    "diff_hunks": (diff_hunks, DIFF_SQL),
    "fused_sources": (fused_sources, _sources_sql()),
}
