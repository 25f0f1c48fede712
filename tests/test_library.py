"""Literal cases of registry, context, gates, notes, math guard and sources."""

import json

import pytest
from pyspark.sql import functions as F

from quire.operators import context, gates, markdown, notes, payloads, registry
from quire.plans import library
from quire.sources import routing


def col(spark, f, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v"))).collect()]


def spans(spark, *rows):
    return spark.createDataFrame(list(rows), "entity string, lo bigint, hi bigint")


def test_missing_spans(spark):
    cases = {"a": ([], (42, 47), [(42, 47)]), "b": ([(42, 90)], (88, 95), [(91, 95)]), "c": ([(42, 90)], (40, 43), [(40, 41)]), "d": ([(42, 90)], (45, 46), []),
             "e": ([(42, 90), (100, 110)], (95, 105), [(95, 99)]), "f": ([(42, 90), (200, 210)], (90, 202), [(91, 199)])}
    held = spans(spark, *((k, *s) for k, (h, _, _) in cases.items() for s in h), ("x", None, 3), (None, 1, 2))
    asked = spans(spark, *((k, *a) for k, (_, a, _) in cases.items()), ("z", 5, 4))
    got = {(r["entity"], r["lo"], r["hi"]) for r in registry.missing_spans(held, asked).collect()}
    assert got == {(k, *s) for k, (_, _, want) in cases.items() for s in want}
    assert registry.missing_spans(held.limit(0), asked.limit(0)).count() == 0


def test_accumulate_only_new_pages(spark):
    pages = spark.createDataFrame([("b", p, f"t{p}") for p in range(780, 800)] + [("c", 790, "x")], "entity string, page int, text string")
    rows, after = registry.accumulated(spans(spark, ("b", 786, 790)), spans(spark, ("b", 788, 795)), pages)
    assert sorted(r["page"] for r in rows.collect()) == list(range(791, 796))
    assert [tuple(r) for r in after.collect()] == [("b", 786, 795)]
    again, _ = registry.accumulated(after, spans(spark, ("b", 788, 795)), pages)
    assert again.count() == 0


def test_registry(spark):
    topics = spark.createDataFrame([("t1", "b", "math", "One", "exam", "1.1", "todo"), ("t2", "b", "math", "Two", "exam", None, "done")], "topic_id string, book_id string, subject string, title string, kind string, section string, status string")
    changed = topics.where("topic_id = 't1'").withColumn("status", F.lit("review"))
    assert {r["topic_id"]: r["status"] for r in registry.merged(topics, changed, "topic_id").collect()} == {"t1": "review", "t2": "done"}
    with pytest.raises(Exception, match="invalid status"):
        registry.merged(topics, changed.withColumn("status", F.lit("lost")), "topic_id").collect()
    with pytest.raises(KeyError):
        registry.found(topics, "topic_id", "t9")
    assert registry.found(topics, "topic_id", "t2").first()["title"] == "Two"
    books = spark.createDataFrame([("b", "math"), ("c", "bio")], "book_id string, subject string")
    new = spark.createDataFrame([(None, "c", "Three Parts", "note", "2.1"), ("t1", "b", "again", "exam", "1.1"), ("t7", "unknown", "x", "exam", None)], "topic_id string, book_id string, title string, kind string, section string")
    got = {r["topic_id"]: (r["subject"], r["status"]) for r in registry.added(topics, new, books).collect()}
    assert got == {"t1": ("math", "todo"), "t2": ("math", "done"), "three-parts": ("bio", "todo")}
    found = spark.createDataFrame([("b", "1.1", "x"), ("b", "1.2", "y")], "book_id string, number string, title string")
    assert [r["number"] for r in registry.unregistered(found, topics).collect()] == ["1.2"]
    titles = spark.createDataFrame([("b", 0, "Preface"), ("b", 1, "1.1 Four Ways"), ("b", 2, "Chapter 1"), ("b", 3, "1.1 again"), ("b", 4, None)], "book_id string, at int, title string")
    assert [tuple(r) for r in registry.outline_sections(titles).collect()] == [("b", "1.1", "Four Ways")]


def test_passages(spark):
    assert col(spark, context.numbered, ["a", " b "], [], None, kind="array<string>") == ["[1] a\n\n[2]  b", "", ""]
    rows = [[("calc", "3.5", "x" * 10), ("alg", None, "y" * 4)], [("calc", "3.5", "x" * 30), ("alg", "", "y")], []]
    got = col(spark, lambda v: context.context_block(v, 24), *rows, kind="array<struct<source:string,section:string,text:string>>")
    assert got == ["SOURCE [calc] (3.5):\nxxxxxxxxxx\n\n---\n\nSOURCE [alg] (sec?):\nyyyy", "", context.NO_SOURCE]
    df = spark.createDataFrame([("g", k, t) for k, t in enumerate(["a", "b", "plain", "an example, a worked one", "sample"])], "g string, k int, t string")
    assert [r["k"] for r in context.part_order(df, "g", "k", "t", "examples").orderBy("place").collect()] == [0, 1, 3, 4, 2]
    assert col(spark, lambda v: context.without_leading_headings(v, "### Problem"), "# T\n## U\n### Problem 1\nx", "1. a\n# b", "# only", None) == ["### Problem 1\nx", "1. a\n# b", "", ""]
    assert col(spark, lambda v: context.badge(v, F.lit("orth")), "calc") == ["[calc · orth]"] and col(spark, lambda v: context.badge(v, F.lit("")), "calc") == ["[calc]"]
    assert col(spark, context.without_front_matter, "---\nt: x\n---\n\nbody", "bare") == ["body", "bare"]


def test_lexical(spark):
    src, long = ["the integral test of convergence"], "photosynthesis happens inside leaves of green plants daily"
    df = spark.createDataFrame([(long, src), ("we use the integral here because it is decreasing", src), ("short", src), (long, []), ("it holds as \\sum_{n=1}^{9} here and there 123 456 789", ["z \\sum_{n=1}^{9} w"])], "a string, s array<string>")
    assert [r[0] for r in df.select(gates.lexical(F.col("a"), F.col("s"))).collect()] == ["off-topic", "words", "short", "free", "formula"]


def test_problem_sets(spark):
    good = "PROBLEM 1\nQuestion: find the limit of 2n.\nSolution: 4 by the integral test\nPROBLEM 2\nQuestion: compute the sum.\nAnswer: 3"
    src = ["the integral test and the limit"]
    df = spark.createDataFrame([("two problems", good), ("4 problems", good), ("a problem", "PROBLEM 1\nFormulate a problem about the limit of something good here"), ("a problem", "PROBLEM 1\nQuestion: find the integral limit of the sum now"), ("x", "no")], "q string, a string")
    assert [r[0] for r in df.select(gates.problem_set(F.col("q"), F.col("a"), F.array(*map(F.lit, src)))).collect()] == ["ok", "few", "meta", "structure", "short"]
    assert col(spark, lambda v: F.size(gates.blocks(v)), good, "intro\n" + good, "no marks", "", None) == [2, 2, 1, 0, 0]


def test_execution(spark):
    run = lambda v, ok=True: (ok, v, None if ok else "ZeroDivisionError")
    rows = [
        ("State the theorem in words.", [], ""), ("Find the smallest n with error < 3.", [], "missing_code_block"), ("so n = 3", [run(None, False)], "execution_error"),
        ("Evaluate it. Answer: 45", [run(32.0)], "value_mismatch"), ("Evaluate it. so n = 32.", [run(32.0)], ""), ("value <<RESULT>>", [run(0.75)], ""),
        ("how many terms <<RESULT>>", [run(-2.0)], "inconsistent_result"), ("x = 4", [run(None)], "inconsistent_result"), ("value <<RESULT>>", [run(float("nan"))], "execution_error"),
    ]
    df = spark.createDataFrame([(t, r) for t, r, _ in rows], "text string, runs array<struct<ok:boolean,value:double,error:string>>")
    got = gates.execution(df).collect()
    assert [r["code"] for r in got] == [c for *_, c in rows] and got[5]["placeholder"] == 0.75
    assert col(spark, lambda v: gates.states_value(v, F.lit(32.0)), "so n = 32.", "answer: 1/32", "132", "0.32", None) == [True, False, False, False, False]


def test_verdicts(spark):
    v = col(spark, gates.verdict, '{"ok": false, "code": "err_logic"}', '{"ok": true, "code": "OK"}', '{"grounded": true, "errors": ["a", "b"], "reason": "r"}', "[1]", "nothing", None, '{"ok": false, "code": "NEW"}')
    assert (v[0]["ok"], v[0]["error_codes"]) == (False, ["logic_error"]) and v[0]["reason"].startswith("judge: logic_error")
    assert (v[1]["ok"], v[1]["reason"], v[1]["error_codes"]) == (True, "judge: OK", [])
    assert (v[2]["ok"], v[2]["grounded"], v[2]["errors"], v[2]["reason"]) == (True, True, ["a", "b"], "r")
    assert [x["reason"] for x in v[3:6]] == ["judge reply not a dict"] * 3 and v[6]["error_codes"] == ["other"]
    assert col(spark, lambda x: gates.said(gates.verdict(x)), '{"ok": false, "reason": "r", "errors": ["e"], "error_codes": ["c"]}') == ["r | err: e | codes: c"]


def test_last_object(spark):
    found = [payloads._last_object(t) for t in ('answer {"a": 1} where x in {not json}', 'prefix {"a":1} suffix', "[1,2]", '{"s": "a } b \\" {"} tail', 'x {"a": 1} {"b": {"c": 2}}', None, "{")]
    assert found == ['{"a": 1}', '{"a":1}', None, '{"s": "a } b \\" {"}', '{"b": {"c": 2}}', None, None]


def test_thinking_and_math(spark):
    texts = ["<think>a<think>b</think>c</think> out", "x</think> y", "x <think>open", "plain < 3", None]
    assert col(spark, markdown.without_nested_thinking, *texts) == ["out", "x y", "x", "plain < 3", None]
    assert col(spark, markdown.has_empty_math, "a $$ $$", "a $x$", "$$\\begin{aligned}$$", "none", None) == [True, False, True, False, False]
    rows = [("a", "Test $f$ converges", "Test $$f$$ converges"), ("b", "Test $f$ converges", "Test $f$ diverges"), ("c", "Test $f$ on", "Test $\\bm f$ on"), ("d", "Test $f$ on", "Test $$ $$ on")]
    got = {r["ident"]: (r["text"], r["reason"]) for r in markdown.guarded_math(spark.createDataFrame(rows, "id string, o string, c string"), "id", "o", "c").collect()}
    assert got["a"] == ("Test $$f$$ converges", "") and got["b"] == (rows[1][1], "non-math text changed")
    assert got["c"][0] == rows[2][1] and got["c"][1].startswith("katex lint") and got["d"] == (rows[3][1], "empty math produced")


PAYLOAD = {"cs": [{"c": "Limit", "d": "near", "m": ""}], "r": "do it", "as": ["one", "", "two"], "ex": [{"p": "P", "s": "S", "src": " 3.5 "}], "pr": ["p1", "p2"], "th": ["T"], "eq": "E"}


def test_notes(spark):
    text = json.dumps(PAYLOAD)
    meta = {"title": F.lit("Lim"), "subject": F.lit("math"), "kind": F.lit("exam"), "section": F.lit(None).cast("string")}
    (note,) = col(spark, lambda v: notes.rendered(v, meta, F.lit("exam")), text)
    places = [note.index(h) for h in ("# Lim", "## Concepts", "## Worked recipe", "## Applications", "## Worked examples", "## Practice problems", "## Theorems", "## Key equations")]
    assert places == sorted(places) and "- one\n- two" in note and "section" not in note and "1. p1\n2. p2" in note and "> 출처: 3.5\n\n**Solution.** S" in note
    (bank,) = col(spark, lambda v: notes.rendered(v, meta, F.lit("problems")), json.dumps({"pr": [{"lvl": "b", "p": "q", "s": "a"}], "cs": []}))
    assert "## Problems\n\n### Basic Problem 1\n\nq\n\n**Solution.** a" in bank and "Concepts" not in bank
    unknown = lambda s: col(spark, lambda v: notes.unknown_keys(v, F.lit(s), F.lit("exam")), '{"eq": "x", "cond": "y", "r": "z"}')[0]
    assert unknown("chem") == [] and unknown("math") == ["cond", "eq"]
    marks = spark.createDataFrame([("a", "### Basic (기초)\n" + "1. x\n" * 10 + "### 중급\n" + "1) x\n" * 5 + "#### Advanced\n" + "2. y\n" * 5), ("b", "### Basic\n1. a"), ("c", None)], "id string, t string")
    counts = notes.bank_counts(marks, "id", "t")
    assert {(r["ident"], r["level"]): r["n"] for r in counts.collect()} == {("a", "basic"): 10, ("a", "intermediate"): 5, ("a", "advanced"): 5, ("b", "basic"): 1}
    assert {r["ident"]: r["issue"] for r in notes.bank_verdicts(counts).collect()} == {"a": "", "b": "basic: got 1, want 10"}
    assert col(spark, lambda v: notes.with_bank(v, F.lit("## Problem Bank\n1. n\n")), "note\n\n## Problem Bank\nold", "note\n") == ["note\n\n\n## Problem Bank\n1. n\n", "note\n\n## Problem Bank\n1. n\n"]


def test_figures(spark):
    figures = spark.createDataFrame([("f1", "b", "3.5 Limits"), ("f2", "b", "3.2"), ("f3", "b", "4.1"), ("f4", "c", "3.5")], "fig_id string, book_id string, section string")
    topics = spark.createDataFrame([("t", "b", "3.5, 3.6"), ("u", "b", None)], "topic_id string, book_id string, section string")
    assert [(r["topic_id"], r["fig_id"]) for r in notes.figures_of(topics, figures).collect()] == [("t", "f1")]
    parsed = spark.createDataFrame([("f1", "b", "9", 0), (None, "b", "8", 1), (None, "b", "8", 1)], "fig_id string, book_id string, section string, at int")
    assert sorted(r["fig_id"] for r in notes.new_figures(figures, parsed).collect()) == ["b-1", "f1", "f2", "f3", "f4"]
    shown = F.array(F.struct(F.lit("f1").alias("fig_id"), F.lit("b").alias("book_id"), F.lit("p.png").alias("path"), F.lit("Cap").alias("caption"), F.lit(4).alias("page")))
    once = col(spark, lambda v: notes.with_figures(v, shown), "note\n")
    assert once == ["note\n\n## Figures\n\n![Cap](p.png)\n*Figure 1. Cap*\n*(source: b, p.4)*\n"] and col(spark, lambda v: notes.with_figures(v, shown), once[0]) == once


def test_rules_and_routes(spark, tmp_path):
    kinds = {"kinds": {"exam": {"r": {"type": "string", "budget": 140}, "cs": {"type": "array", "max": 3, "fields": {"c": {"budget": 12}, "d": {"budget": 90}}}, "as": {"type": "array", "max": 3, "budget": 50}}}}
    (tmp_path / "rules.json").write_text(json.dumps(kinds))
    rules = routing.rule_table(spark, f"file://{tmp_path}/rules.json")
    assert [tuple(r) for r in notes.ceilings(rules).collect()] == [("exam", 140 + 3 * 102 + 150)]
    issues = spark.createDataFrame([("a", f"s{k}", f"m{k}") for k in range(10)] + [("a", "", "x")], "id string, slot string, message string")
    assert notes.patches(issues).first()["slots"][:2] == ["s0", "s1"] and len(notes.first_issues(issues).first()["messages"]) == 8
    files = spark.createDataFrame([("x.pdf", None), ("x.txt", None), ("x.epub", None), ("x.txt", "docling"), ("y.md", "odd")], "path string, parser string")
    got = routing.routed(files).collect()
    assert [r["parser"] for r in got] == ["fast", "text", None, "docling", "odd"] and [r["error"] is None for r in got] == [True, True, False, True, False]
    read = routing.parse_sources(spark, files, {"text": lambda df: df.withColumns({"markdown": F.lit("# x"), "pages": F.lit(1)})}).collect()
    assert sorted((r["path"], r["error"] is None) for r in read) == [("x.epub", False), ("x.pdf", False), ("x.txt", False), ("x.txt", True), ("y.md", False)]
    for name in ("b.md", "a.txt", "c.pdf", "d.doc"):
        (tmp_path / name).write_text("x")
    found = routing.listing(spark, f"file://{tmp_path}")
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["a.txt", "b.md", "c.pdf"]
    assert routing.stale(found, F.lit("1990-01-01").cast("timestamp")).count() == 0
    servers = routing.server_table(spark, {"worker": "u1, u2"}, {"worker": "d", "coder": "c"})
    assert {(r["role"], r["at"], r["url"]) for r in servers.collect()} == {("worker", 0, "u1"), ("worker", 1, "u2"), ("coder", 0, "c")}


def test_library_queries_are_registered():
    from quire.plans import registry as all_queries

    assert set(library.QUERIES) <= set(all_queries.QUERIES) and set(library.SQL) <= set(library.QUERIES)
