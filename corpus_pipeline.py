"""The corpus pipeline: five stages, each of which works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.llm import bpe, catalog, lang_id, mixing, near_dup, runtime, suffix_dedup

#: The same operators as the queries, with the same parameters.
WEIGHTS, MOST_EPOCHS = (5, 2, 1), 3
#: Passages of over 50 words that stand elsewhere go.  They are found as repeated strings of so many bytes at least: words of
#: less than four letters on average make shorter passages, which stay (on check_s 3% of those of 51 to 59 words, all
#: of them one word over and over).
REPEAT_BYTES, REPEAT_WORDS = catalog.PASSAGE
TOKENIZER = catalog.TOKENIZER


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is identified; texts without a letter, or unlike all languages, go."""
    return lang_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates."""
    return near_dup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that stand elsewhere too; nothing else is touched."""
    done = suffix_dedup.remove_repeats(docs, REPEAT_BYTES, words=REPEAT_WORDS)
    cut = F.col("dedup_removed") > 0
    done = done.withColumn("text", F.when(cut, F.col("dedup_text")).otherwise(F.col("text")))
    return done.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it."""
    return mixing.materialise_mix(docs, WEIGHTS, MOST_EPOCHS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of ids and decoded text."""
    return bpe.encode_documents(docs, TOKENIZER, decoded=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("encoded", encoded),
]

#: No SQL expresses a trained classifier, signatures or merges: tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each one's result written as Parquet and read again.

    What a stage has left in the shared folder is deleted once its result is written.
    """
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), runtime.mark()
    for name, stage in STAGES[:-1]:
        docs = runtime.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        runtime.clean(spark, begun, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
