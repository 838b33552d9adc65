"""Stages of the pipeline against brute force, on small tables with passages, copies, hard rows and clashing columns."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from seekframe.llm import mixing
from tests.llm.test_small import brute_classes, brute_flags, brute_passages

STAGES = dict(corpus_pipeline.STAGES)
CLASHING = ("__near_id", "__near_node", "__mix_id", "__mix_copies", "k1", "k2", "t", "row", "spans", "own_id", "node", "bands", "lang_pred", "rejected", "n_tokens")


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [some(n) for n in (45, 50, 52, 60, 70, 90, 150)]
    texts: list = [None, "", "  ", "\u00a0", "x " * 5000]
    for p in passages:
        texts += [f"{some(300)}\n{p}\n{some(200)}" for _ in range(3)]
    long = some(400)
    texts += [long, long + " " + some(3), some(4) + " " + long, long]
    texts += [some(rng.randrange(60, 300)) for _ in range(20)]
    return passages, [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def test_repeated_passages_equal_brute_force(spark):
    passages, rows = corpus()
    df = frame(spark, rows)
    got = STAGES["repeated_passages"](spark, df, "")
    assert got.columns == df.columns
    left = {r["doc_id"]: r for r in got.collect()}
    flags = brute_flags([r[1] for r in rows], corpus_pipeline.REPEAT_BYTES)
    for (i, t, *_), gone in zip(rows, flags, strict=True):
        b = bytearray((t or "").encode())
        for x, y in reversed(brute_passages(t, gone, corpus_pipeline.REPEAT_WORDS)):
            del b[x:y]
        assert (left[i]["text"] or "") == b.decode() and left[i]["k1"] == "x"
        assert left[i]["n_chars"] == len(left[i]["text"] or "")
    for p in passages:
        there = sum(p in (r["text"] or "") for r in left.values())
        assert there == (0 if len(p.split()) > 50 else 3)
    clean = [i for i, t, *_ in rows if t and i >= len(rows) - 20]
    assert all(left[i]["text"] == rows[i][1] for i in clean)


def test_near_duplicates_equal_brute_force(spark):
    _, rows = corpus()
    df = frame(spark, rows)
    got = STAGES["near_duplicates"](spark, df, "")
    assert got.columns == df.columns
    named = {i: c for i, c in brute_classes(rows)}
    wordless = {i for i, t, *_ in rows if not (t or "").strip(" \n\t\r\x0b\x0c")}
    assert {r["doc_id"] for r in got.collect()} == {int(c) for c in named.values()} | wordless


def test_mixture_takes_rows_as_decided(spark):
    _, rows = corpus()
    df = frame(spark, rows + rows[:8])
    got = Counter(r["doc_id"] for r in STAGES["mixture"](spark, df, "").collect())
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(df).groupBy("doc_id").agg(F.max("copies").alias("copies")).collect()}
    repeated = Counter(r[0] for r in rows + rows[:8])
    assert got == Counter({i: n * repeated[i] for i, n in copies.items() if n})


def test_empty_documents(spark, tmp_path):
    _, rows = corpus()
    empty = frame(spark, rows).where("false")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
        if name != "encoded":
            assert out.columns == empty.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
