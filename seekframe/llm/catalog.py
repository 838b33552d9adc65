"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.llm import ann, bpe, html_extract, lang_id, mixing, near_dup, suffix_dedup, topk, url_filter, warc
from seekframe.llm.runtime import new_path, release

#: The vocabulary of op9: a file of the public tokenizers that every machine has; its path is a parameter.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (verdict, host, path): the rules of op6.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), (5, 2, 1), 3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: op3 also reports passages of over 50 words that stand elsewhere: strings of at least so many bytes with more whole words than that.
PASSAGE = (240, 50)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), 400, PASSAGE)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "keep")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), folder)
    release(spark)
    # of responses the payload itself is measured; of revisits the header says what it was
    full = warc.load(spark, folder, ["record_type", "page_id", "payload"]).where(F.col("record_type") == "response")
    full = full.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), warc.base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    heads = warc.load(spark, folder, ["record_type", "page_id", "payload_bytes", "payload_digest", "refers_to"]).where(F.col("record_type") == "revisit")
    heads = heads.select("page_id", "payload_bytes", "payload_digest", "record_type", warc.referred_page(F.col("refers_to")).alias("refers_to"))
    return full.unionByName(heads)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer, ids=False, decoded=False)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lang_id": op1_lang_id,
        "op2_mix": op2_mix,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_ann": op4_ann,
        "op5_near_dup": op5_near_dup,
        "op6_url_filter": op6_url_filter,
        "op7_warc": op7_warc,
        "op8_html": op8_html,
        "op9_bpe": op9_bpe,
        "op10_top_k": op10_top_k,
    }


OP2_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS h, length(text) AS chars,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), keyed AS (
  SELECT doc_id, source, h, size,
         -ln((('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, '') || '|' || h), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
         / CASE WHEN chars / greatest(size, 1)::DOUBLE BETWEEN 3 AND 12 THEN 1::DOUBLE ELSE 0.5::DOUBLE END AS key
  FROM rows
), sources AS (
  SELECT source, sum(size)::BIGINT AS s, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM keyed GROUP BY source
), ratios AS (
  SELECT *, 3 * s / w AS ratio, sum(s) OVER () AS total,
         coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_from
  FROM sources
), capped AS (
  SELECT *, ratio <= (total - cap_before) / w_from AS is_capped FROM ratios
), shares AS (
  SELECT source, s, CASE WHEN is_capped THEN (3 * s)::DOUBLE
    ELSE w * (total - coalesce(sum(CASE WHEN is_capped THEN 3 * s END) OVER (), 0))::DOUBLE / sum(CASE WHEN NOT is_capped THEN w END) OVER () END AS target
  FROM capped
), budgets AS (
  SELECT source, s, target, CASE WHEN s = 0 THEN 0 ELSE floor(target / s) END::BIGINT AS epochs FROM shares
), ordered AS (
  SELECT k.doc_id, k.size, b.s AS source_size, b.target, b.epochs,
         floor(b.target - b.epochs * b.s + 0.5)::BIGINT AS budget,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - start)))::BIGINT AS taken FROM ordered
"""

OP6_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), judged AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM split
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""

OP7_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM r
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), scored AS (
  SELECT a.id AS query_id, b.id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix": OP2_SQL, "op6_url_filter": OP6_SQL, "op7_warc": OP7_SQL, "op10_top_k": OP10_SQL}
