from pyspark.sql import functions as F

from quire.functions.text import file_slug, mixed_tokens, slug, third_tokens
from quire.functions.vectors import cosine, parse_vector
from quire.operators import markdown, planning, search, store


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens(spark):
    assert one(spark, mixed_tokens, "abcde") == 2
    assert one(spark, mixed_tokens, "가나 a") == 3
    assert one(spark, mixed_tokens, None) == 1 and one(spark, third_tokens, "") == 1 and one(spark, third_tokens, "abcd") == 2


def test_slugs(spark):
    assert one(spark, slug, "  Multi   Word  Title  ") == "multi-word-title"
    assert one(spark, slug, "???") == "untitled" and one(spark, slug, None) == "untitled"
    assert one(spark, file_slug, "3.1 A_b") == "3.1-A_b" and one(spark, file_slug, " ") == "range"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert one(spark, parse_vector, "[1,2]") == [1.0, 2.0] and one(spark, parse_vector, " ") == []


def test_headings(spark):
    text = "1.1 Basic Concepts. Modeling\n25.4 Testing Hypotheses. Decisions 1077\n1.06 US quart) is vibrating up and down under\n/H11005\n# \nText."
    assert one(spark, markdown.promoted_headings, text) == "## 1.1 Basic Concepts. Modeling\n25.4 Testing Hypotheses. Decisions 1077\n1.06 US quart) is vibrating up and down under\nText."
    contents = "\n".join(f"1.{k} Some Title" for k in range(1, 9))
    assert one(spark, markdown.promoted_headings, contents) == contents


def test_sections_and_chunks(spark):
    docs = spark.createDataFrame([("b", "# Chapter 1\n\n## 1.1 Limits\n\naaa\n\n## 1.2 Continuity\nbbb\nccc"), ("s", "# Short\n\nhi\n"), ("e", "   \n\n"), ("h", "# Only"), ("n", None)], "id string, text string")
    got = {(r["ident"], r["section"]): r["body"].strip() for r in markdown.sections(docs, "id", "text").collect()}
    assert got == {("b", "1.1 Limits"): "aaa", ("b", "1.2 Continuity"): "bbb\nccc", ("s", "Short"): "hi", ("h", ""): "# Only"}
    rows = {r["chunk_id"]: (r["text"], r["tokens"]) for r in markdown.chunked(docs, "id", "text").collect()}
    assert rows["s-0000"] == ("hi", 1) and rows["b-0001"][0] == "bbb ccc"
    long = spark.createDataFrame([("x", "# 1.1\n" + "y" * 1000)], "id string, text string")
    parts = markdown.chunked(long, "id", "text", target=10, most=12, overlap=3).collect()
    assert all(r["tokens"] <= 12 and r["section"] == "1.1" for r in parts) and sum(len(r["text"]) for r in parts) >= 1000


def test_lint(spark):
    docs = spark.createDataFrame([("a", "\\begin{align} x"), ("b", "$\\bm x$"), ("c", "a $x"), ("d", "$\\foo$"), ("e", "$\\frac{1}{2}$ fine"), ("f", None)], "id string, text string")
    got = {}
    for r in markdown.lint(docs, "id", "text").collect():
        got.setdefault(r["ident"], set()).add((r["line"], r["message"]))
    assert got["a"] == {(1, "forbidden env '{align}'")} and got["b"] == {(1, "forbidden macro '\\bm'")}
    assert got["c"] == {(1, "odd number of '$' on line (unbalanced math)"), (0, "unbalanced '$' across document (net 1)")}
    assert got["d"] == {(1, "macro not in allowed set: '\\foo'")} and "e" not in got and "f" not in got


def test_small_texts(spark):
    assert one(spark, markdown.without_fences, "```json\n{}\n```") == "{}"
    assert one(spark, markdown.without_thinking, "<think>a</think>b<think>c") == "b<think>c"
    assert one(spark, markdown.dollar_math, r"\[x\] and \(y\)") == "$$x$$ and $y$"
    assert one(spark, markdown.word_signature, "Test $f$ converges") == one(spark, markdown.word_signature, "Test $$f$$ converges") == ["Test", "converges"]


def test_plans(spark):
    plan = "[Task 1: implement solver]\nFile: heat_solver.py\nwrite it\n[Task 2: fix the bug]\nx\n[Task 3: explain]\nTheorem\n[Task 4: prove it]\ny"
    rows = planning.split_plans(spark.createDataFrame([("p", plan), ("q", "## Task A\nfind z"), ("r", "nothing"), ("s", None)], "plan_id string, plan string")).orderBy("plan_id", "id").collect()
    assert [(r["plan_id"], r["id"], r["action"], r["role"]) for r in rows] == [
        ("p", 1, "code", "coder"), ("p", 2, "fix", "coder"), ("p", 3, "explain", "worker"), ("p", 4, "proof", "reasoner"), ("q", 1, "search", "worker"),
    ]
    assert rows[0]["target"] == "heat_solver.py" and rows[1]["target"] == ""


def test_gates(spark):
    df = spark.createDataFrame([
        ("about 32 terms needed", "n = 32", "how many terms"), ("about 32 terms needed", "n = 45", "how many terms"), ("about 32 terms needed", "not covered in the supplied source", "how many terms"),
        ("about 32 terms needed", "n = 45", "state theorem"), ("about 32 terms needed", "many", "how many terms"), ("no outcome here 7", "8", "how many"), (None, None, None),
    ], "source string, answer string, question string")
    assert [r[0] for r in df.select(planning.anchored(F.col("answer"), F.col("source"), F.col("question"))).collect()] == [True, False, True, True, False, True, True]
    assert one(spark, planning.too_short, "x" * 39 + "  ") is True and one(spark, planning.too_short, "x" * 40) is False


def test_batches_and_budget(spark):
    rows = [("g", k, 30) for k in range(10)] + [("h", 0, 99)]
    df = spark.createDataFrame(rows, "g string, k int, n int")
    kept = planning.within_budget(df, "g", "k", "n", 90).collect()
    assert sorted((r["g"], r["k"]) for r in kept) == [("g", 0), ("g", 1), ("g", 2), ("h", 0)]
    got = {(r["g"], r["k"]): r["batch"] for r in planning.batches(df, "g", "k", "n", 70).collect()}
    assert [got["g", k] for k in range(10)] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5] and got["h", 0] == 1


def test_search(spark):
    chunks = spark.createDataFrame([("a", "limit of a sequence", [1.0, 0.0]), ("b", "Derivatives", [0.0, 1.0]), ("c", "other", [0.0, 0.0])], "chunk_id string, text string, vector array<double>")
    ask = spark.createDataFrame([("q", "limit sequence", [1.0, 0.0]), ("r", "derivative", [0.0, 1.0]), ("s", "the-r", [1.0, 1.0]), ("t", "equ", [9.0, 0.0])], "query string, text string, qvec array<double>")
    assert {(r["query"], r["chunk_id"]) for r in search.dense(chunks, ask, 1).collect()} == {("q", "a"), ("r", "b"), ("s", "a"), ("t", "a")}
    got = {(r["query"], r["chunk_id"]): r["score"] for r in search.bm25(chunks, ask, 5).collect()}
    assert ("q", "a") in got and ("r", "b") in got and got["t", "a"] == 0.5
    both = search.hybrid(chunks, ask, spark.createDataFrame([("q", "b")], "query string, chunk_id string")).where("query = 'q'").orderBy("role").collect()
    assert [(r["chunk_id"], r["role"]) for r in both] == [("a", "crossref"), ("b", "primary")]
    filled = search.back_filled(search.dense(chunks, ask, 1), search.bm25(chunks, ask, 5), 2)
    assert {(r["chunk_id"], r["mode"]) for r in filled.where("query = 'q'").collect()} == {("a", "dense")}


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("b-0000", "b", "s", 0, "x"), ("c-0000", "c", "s", 0, "y")], "chunk_id string, book_id string, section string, seq int, text string")
    new = old.where("book_id = 'b'").withColumn("text", F.lit("z"))
    assert {r["text"] for r in store.upserted(old, new, "chunk_id").collect()} == {"z", "y"}
    more = spark.createDataFrame([("b", 1, "s", "t"), ("d", 1, "s", "u")], "book_id string, ord int, section string, text string")
    assert {r["chunk_id"] for r in store.appended(old, more).collect()} == {"b-0001", "d-0000"}
    path = str(tmp_path / "store")
    store.write_books(old, path)
    store.write_books(new, path)
    assert {r["text"] for r in spark.read.parquet(path).collect()} == {"z", "y"}


def test_files(spark, tmp_path):
    from quire.sources.files import json_chunks, text_documents, write_json_chunks

    (tmp_path / "a.md").write_text("# A\n\ntext\n")
    (tmp_path / "b.pdf").write_text("no")
    assert [(r["book_id"], r["markdown"]) for r in text_documents(spark, str(tmp_path)).collect()] == [("a", "# A\n\ntext\n")]
    (tmp_path / "s.jsonl").write_text('{"chunk_id": "x", "book_id": "b", "text": "t"}\n\n')
    row = json_chunks(spark, str(tmp_path / "s.jsonl")).first()
    assert (row["section"], row["seq"], row["vector"]) == ("", 0, [])
    write_json_chunks(json_chunks(spark, str(tmp_path / "s.jsonl")), str(tmp_path / "out"))
    assert json_chunks(spark, str(tmp_path / "out")).count() == 1


def test_accumulate_twice(spark, tmp_path):
    from quire.streaming.accumulate import accumulate

    source = tmp_path / "in" / "t.parquet"
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    df.coalesce(1).toPandas().to_parquet(source) if source.parent.mkdir() is None else None
    for _ in range(2):
        assert accumulate(spark, str(tmp_path / "in"), "t", str(tmp_path / "out"), str(tmp_path / "state"), ["k"]).count() == 2


def test_accumulate_table_in_a_folder(spark, tmp_path):
    from quire.streaming.accumulate import accumulate

    source = str(tmp_path / "in" / "t.parquet")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").repartition(3).write.parquet(source)
    load = lambda: sorted(tuple(r) for r in accumulate(spark, str(tmp_path / "in"), "t", str(tmp_path / "out"), str(tmp_path / "state"), ["k"]).collect())
    assert load() == load() == [(1, "a"), (2, "b")]
    spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string").repartition(2).write.mode("append").parquet(source)
    assert load() == [(1, "a"), (2, "b"), (3, "c")]


def test_leading_digits_stay(spark):
    rows = planning.split_plans(spark.createDataFrame([("p", "[Task 1: explain]\n012.6 x\n110 y")], "plan_id string, plan string")).collect()
    assert rows[0]["input"] == "012.6 x\n110 y"
    topics = spark.createDataFrame([("t", "b", "3.10, 1.1")], "topic_id string, book_id string, section string")
    chunks = spark.createDataFrame([("c", "b", "3.10 Ten"), ("d", "b", "3.1 One"), ("e", "b", "1.1 First")], "chunk_id string, book_id string, section string")
    assert {r["chunk_id"] for r in search.section_members(topics, chunks).collect()} == {"c", "e"}
