from pyspark.sql import functions as F

from quire.models import HashedWords, embedded, reranked
from quire.operators import answers, payloads
from quire.plans.ingest import ingest


def col(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_json(spark):
    assert col(spark, payloads.last_object, 'prefix {"a":1} suffix', "[1,2]", '{"a": "}"} {"b": {', None, "") == ['{"a":1}', None, '{"a": "}"}', None, None]
    assert col(spark, payloads.strict_json, '```json\n{"a":1}\n```', "no") == ['{"a":1}', None]


def test_issues(spark):
    rules = spark.createDataFrame(
        [("exam", "cs", "array", 2, None, "d", 5), ("exam", "cs", "array", 2, None, "c", 5), ("exam", "r", "string", None, 4, None, None)],
        "kind string, slot string, type string, max int, budget int, field string, field_budget int",
    )
    rows = [
        ("ok", "exam", '{"cs": [{"d": "x", "c": "y"}], "r": "fine"}'), ("long", "exam", '{"cs": [{"d": "%s"}], "r": "%s"}' % ("x" * 99, "y" * 99)), ("many", "exam", '{"cs": [{"d":"1"},{"d":"2"},{"q":"3"}]}'),
        ("odd", "exam", '{"zz": "1", "r": "", "cs": "text"}'), ("bad", "exam", "[1]"), ("null", "exam", None),
    ]
    got = {}
    for r in payloads.issues(spark.createDataFrame(rows, "id string, kind string, payload string"), rules).collect():
        got.setdefault(r["id"], set()).add((r["slot"], r["message"]))
    assert got == {
        "long": {("cs", "cs[0].d: exceeds budget 5"), ("r", "exceeds budget 4")}, "many": {("cs", "more than 2 items"), ("cs", "cs[2].q: unknown field")},
        "odd": {("zz", "unknown key"), ("r", "empty"), ("cs", "must be an array")}, "bad": {("", "not an object")}, "null": {("", "not an object")},
    }


def test_usage(spark):
    df = spark.createDataFrame([("r", '{"prompt": 3, "cache_hit": 1}'), ("r", '{"prompt": 4}'), ("r", None)], "run string, usage string")
    assert tuple(payloads.usage_totals(df, "run", "usage").first()) == ("r", 7, 0, 1, 0)


def test_parts(spark):
    df = spark.createDataFrame([(1, "intro\n## Problem 1\na\n**Problem 2**\nb"), (2, "whole"), (3, None)], "id int, answer string")
    assert [(r["id"], r["block"]) for r in answers.problem_blocks(df).orderBy("id", "block").collect()] == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert col(spark, answers.code_blocks, "```python\nx\n``` y ```\nx\n``` ```\nz\n```") == [["x\n", "z\n"]]
    assert col(spark, lambda x: answers.states_integer(x, F.lit(32)), "so n = 32.", "answer: 1/32", "132", None) == [True, False, False, False]
    assert col(spark, answers.requested_count, "Make two practice problems", "3 exercises", "a problem", None) == [2, 3, 1, 1]
    assert col(spark, lambda x: answers.with_result(x, F.lit(0.75)), "x = <<RESULT>>") == ["x = 0.75"]


def test_symbols(spark):
    files = spark.createDataFrame([("heat.py", 'def euler_step(u):\n    """Explicit heat timestep."""\n    return grid(u)\n'), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    rows = answers.code_symbols(files).withColumn("score", answers.symbol_score(F.col("name"), F.col("doc"), F.lit("explicit euler heat timestep"))).collect()
    assert [(r["path"], r["name"], r["line"], r["calls"], r["score"]) for r in rows] == [("heat.py", "euler_step", 1, ["grid"], 10)]


def test_models(spark):
    class Lengths:
        def score(self, asked, texts):
            return [len(t) for t in texts]

    df = spark.createDataFrame([("q", "a", "x", "1"), ("q", "b", "x", "333"), ("q", "c", "x", "22")], "query string, chunk_id string, query_text string, text string")
    assert [r["chunk_id"] for r in reranked(df, Lengths, 2).orderBy("place").collect()] == ["b", "c"]
    one, many = ([r["vector"] for r in embedded(df, "text", HashedWords, batch=b).collect()] for b in (1, 32))
    assert one == many and len(one[0]) == 256


def test_ingest(spark):
    docs = spark.createDataFrame([("a", "# 1.1 A\n\ntext here", 1 - 1), ("b", "tiny", 200), ("c", "", None), ("d", "# x\n\ny", None)], "book_id string, markdown string, pages int")
    chunks, report = ingest(docs, spark.createDataFrame([("d",)], "book_id string"), HashedWords)
    assert {r["book_id"]: r["outcome"] for r in report.collect()} == {"a": "ingested", "b": "failed", "c": "failed", "d": "skipped"}
    assert [(r["book_id"], r["text"]) for r in chunks.collect()] == [("a", "text here")]
