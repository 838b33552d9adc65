"""The registered queries and the pipeline on the small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seekframe.llm import catalog, runtime
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(name, spark, sf_dir, oracle):
    same_rows(catalog.queries()[name](spark, sf_dir), oracle.sql(catalog.oracle_sql()[name]))


def test_ten_queries(spark, sf_dir):
    names = [n.split("_")[0] for n in catalog.queries()]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 11))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = runtime.materialise(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        sizes.append(docs.count())
        if name != "mixture":
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert sizes[1] >= 0.98 * sizes[0]  # clean documents stay
    assert sizes[2] < sizes[1] and sizes[3] == sizes[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == sizes[4]
    assert corpus_pipeline.run(spark, sf_dir).agg(F.sum("n_tokens")).first()[0] == last.agg(F.sum("n_tokens")).first()[0]


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(1, "the thing is there", "en", "a", 3), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "the thing is there", "en", "b", 3), (None, "where is the thing", "en", None, 1), (5, "x " * 20000, "en", "a", 9)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("id", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1
