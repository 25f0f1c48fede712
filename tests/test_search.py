"""Retrieval: both ways of each ranking give the same, repeats count once."""

import numpy as np
from pyspark.sql import functions as F

from quire.operators import search


def test_dense_ways_agree(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(f"c{k:03d}", v.tolist()) for k, v in enumerate(rng.standard_normal((120, 8)))]
    rows += rows[:40] * 3 + [("z", [0.0] * 8), ("n", None), ("nan", [float("nan")] * 8), ("short", [1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, vector array<double>").coalesce(2)
    queries = spark.createDataFrame([("a", rows[3][1]), ("b", rows[50][1]), ("s", [2.0]), ("e", []), ("x", None)], "query string, qvec array<double>")
    one = sorted((r["query"], r["chunk_id"], r["place"], round(r["score"], 9)) for r in search.dense(chunks, queries, 5).collect())
    monkeypatch.setattr(search, "SENT", 0)
    two = sorted((r["query"], r["chunk_id"], r["place"], round(r["score"], 9)) for r in search.dense(chunks, queries, 5).collect())
    assert one == two and len(one) == 11 and ("a", "c003", 1, 1.0) in one
    assert search.dense(chunks, queries.limit(0), 5).count() == 0


def test_bm25_ways_agree(spark, monkeypatch):
    rows = [("d1", "The derivative of a limit."), ("d2", "Derivatives and limits: limit sequence"), ("d3", "no match here"), ("d4", None), ("d1", "The derivative of a limit."), ("d5", "x-y zzzq")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    queries = spark.createDataFrame([("q1", "derivative"), ("q2", "limit sequence"), ("q3", "a"), ("q4", "zq"), ("q5", None)], "query string, text string")
    run = lambda: sorted((r["query"], r["chunk_id"], round(r["score"], 9)) for r in search.bm25(chunks, queries, 9).collect())
    one = run()
    monkeypatch.setattr(search, "TERMS", 0)
    assert one == run() and {r[:2] for r in one} == {("q1", "d1"), ("q1", "d2"), ("q2", "d1"), ("q2", "d2"), ("q3", "d1"), ("q4", "d5")}
    assert [r[2] for r in one if r[0] == "q4"] == [0.5]


def test_keywords(spark):
    chunks = spark.createDataFrame([("a", "sin integral", "symmetric"), ("a", "sin integral", "symmetric"), ("b", None, "integral"), ("c", "", None)], "chunk_id string, title string, body string")
    queries = spark.createDataFrame([("q", "sin symmetric interval integral")], "query string, text string")
    got = [(r["chunk_id"], r["score"], r["place"]) for r in search.keywords(chunks.withColumn("w", F.lit(9)), "title", "body", queries, 5).orderBy("place").collect()]
    assert got == [("a", 7, 1), ("b", 1, 2)]
