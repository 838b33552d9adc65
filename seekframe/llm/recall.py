"""Recall of the nearest neighbours that op4 finds, against brute force: ``python -m seekframe.llm.recall FOLDER``."""

from __future__ import annotations

import json
import sys

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seekframe.functions.shipping import ship_package
from seekframe.llm import ann, catalog

K = 20


def measure(spark: SparkSession, folder: str) -> dict:
    """The share of the exact ``K`` best of each query that the search finds; queries are compared in blocks with all rows."""
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = table.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>")).orderBy("vec_id").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    found: dict[int, set[int]] = {}
    for r in catalog.op4_ann(spark, folder).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    asks, shares = np.flatnonzero(ids % 20 == 0), []
    for first in range(0, len(asks), 256):
        own = asks[first : first + 256]
        scores = vectors[own] @ vectors.T
        scores[np.arange(len(own)), own] = -np.inf
        for q, row in zip(own, scores, strict=True):
            best = np.lexsort((ids, -row))[:K]
            shares.append(len(found[ids[q]] & set(ids[best].tolist())) / min(K, len(ids) - 1))
    return {"vectors": len(ids), "queries": len(asks), "fraction met": ann.FRACTION, "recall": round(float(np.mean(shares)), 4), "least recall of a query": round(float(np.min(shares)), 2)}


if __name__ == "__main__":
    session = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    print(json.dumps(measure(session, sys.argv[1])))
