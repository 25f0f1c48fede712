"""Queries of the core operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import dotted_numbers, file_slug, first_number, mixed_tokens, slug, third_tokens
from quire.functions.vectors import stub_embedding
from quire.operators import markdown, planning, registry, search, store
from quire.operators.payloads import strict_json
from quire.operators.planning import ABSENT, BODY_RULES, HEADING_RULES, INTENT, OUTCOME
from quire.session import table

SEARCHES = [("q1", "induction step"), ("q2", "buffer solution"), ("q3", "엔트로피 전기장"), ("q4", "memory leak thread"), ("q5", "the determinant")]
SECTIONS = {"q1": "1.1", "q2": "4.1", "q3": "6.2", "q4": "8.1", "q5": "10.1"}
PAGE, BUDGET = 100, 2000


def _chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Chunks with each repeat once."""
    return table(spark, sf_dir, "chunks", *columns).distinct()


def _searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query string, text string")


def store_stats(spark, sf_dir):
    return store.stats(_chunks(spark, sf_dir, "chunk_id", "book_id"))


def store_next_seq(spark, sf_dir):
    return store.next_seq(table(spark, sf_dir, "chunks", "book_id", "seq"))


def store_upsert(spark, sf_dir):
    """Changed rows (sections named), repeated ones and new ones (a copy of each oversized chunk under a new id)."""
    old = _chunks(spark, sf_dir, "chunk_id", "book_id", "section", "tokens")
    changed = old.where("section is null").withColumn("section", F.lit("untitled"))
    new = old.where("tokens > 500").withColumn("chunk_id", F.concat("chunk_id", F.lit("-copy")))
    return store.upserted(old, changed.unionByName(changed).unionByName(new), "chunk_id").select("chunk_id", "book_id", "section")


def dense_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec"))
    best = search.dense(rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), asked, 10)
    return best.select("query", "chunk_id", "place")


def bm25_topk(spark, sf_dir):
    best = search.bm25(table(spark, sf_dir, "chunks", "chunk_id", "text"), _searches(spark), 20)
    return best.select("query", "chunk_id", F.round("score", 6).alias("score"))


def hybrid_search(spark, sf_dir):
    """The stated searches with a stated vector; chunks of a stated section number come first."""
    chunks = table(spark, sf_dir, "chunks", "chunk_id", "section", "text", "vector")
    numbers = spark.createDataFrame(list(SECTIONS.items()), "query string, number string")
    first = chunks.select("chunk_id", F.explode(dotted_numbers(F.col("section"))).alias("number")).join(numbers, "number").select("query", "chunk_id").distinct()
    asked = _searches(spark).withColumn("qvec", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.pmod(i * 37, F.lit(64)) / 64.0 - 0.5))
    return search.hybrid(chunks, asked, first)


def section_members(spark, sf_dir):
    topics = table(spark, sf_dir, "topics", "topic_id", "book_id", "section").distinct()
    return search.section_members(topics, _chunks(spark, sf_dir, "chunk_id", "book_id", "section"))


def keyword_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "chunks", "chunk_id", "section", "text")
    return search.keywords(rows, "section", "text", _searches(spark), 20).select("query", "chunk_id", "score", "place")


def token_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "chunks", "chunk_id", "book_id", "text").select("chunk_id", "book_id", mixed_tokens(F.col("text")).alias("mixed"), third_tokens(F.col("text")).alias("thirds")).distinct()
    return rows.groupBy("book_id").agg(F.sum("mixed").alias("mixed"), F.sum("thirds").alias("thirds"))


def title_slugs(spark, sf_dir):
    return table(spark, sf_dir, "topics", "topic_id", "title").distinct().select("topic_id", slug(F.col("title")).alias("slug"), file_slug(F.col("title")).alias("file_slug"))


def section_numbers(spark, sf_dir):
    rows = _chunks(spark, sf_dir, "chunk_id", "section")
    return rows.select("chunk_id", first_number(F.col("section")).alias("first"), F.size(dotted_numbers(F.col("section"))).alias("n"))


def discovered_sections(spark, sf_dir):
    return registry.discovered(_chunks(spark, sf_dir, "book_id", "section", "seq"), table(spark, sf_dir, "topics", "topic_id", "book_id", "section"))


def clean_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "parsed_books", "path", "markdown").where("markdown is not null")
    return rows.select("path", F.md5(markdown.clean_glyphs(F.col("markdown"))).alias("digest")).distinct()


def promoted_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "parsed_books", "path", "markdown").distinct()
    return rows.select("path", markdown.promoted_headings(F.col("markdown")).alias("markdown"))


def scanned_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "parsed_books", "path", "markdown", "pages")
    return rows.select("path", markdown.looks_scanned(F.col("markdown"), F.col("pages")).alias("scanned")).distinct()


def page_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "parsed_books", "path", "markdown").distinct()
    return markdown.sections(rows, "path", "markdown").select("ident", "section", "ord", F.md5("body").alias("digest"))


def page_chunks(spark, sf_dir):
    return markdown.chunked(table(spark, sf_dir, "parsed_books", "path", "markdown").distinct(), "path", "markdown")


def math_lint(spark, sf_dir):
    once = table(spark, sf_dir, "chunks", "chunk_id", "text").where("contains(text, '$') or contains(text, '\\\\')").distinct()  # other texts hold no math
    return markdown.lint(once, "chunk_id", "text")


def dollar_balance(spark, sf_dir):
    return table(spark, sf_dir, "chunks", "chunk_id", "text").where("text is not null").select("chunk_id", F.regexp_count("text", F.lit(r"(?<!\\)\$")).alias("dollars")).distinct()


def word_signatures(spark, sf_dir):
    rows = table(spark, sf_dir, "chunks", "chunk_id", "text").where("text is not null")
    return rows.select("chunk_id", F.md5(F.array_join(markdown.word_signature(F.col("text")), " ")).alias("digest")).distinct()


def task_classes(spark, sf_dir):
    action, role = planning.classify(F.col("action"), F.col("input"))
    rows = table(spark, sf_dir, "tasks", "run_id", "task", "action", "input").distinct()
    return rows.select("run_id", "task", action.alias("class"), role.alias("role"), planning.token_budget(action, role).alias("budget"))


def plan_tasks(spark, sf_dir):
    rows = table(spark, sf_dir, "tasks", "run_id", "task", "action", "input").distinct()
    text = F.concat(F.lit("[Task "), F.col("task").cast("string"), F.lit(": "), F.coalesce("action", F.lit("")), F.lit("]\n"), F.coalesce("input", F.lit("")))
    plans = rows.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("task", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("plan"))
    return planning.split_plans(plans.withColumnRenamed("run_id", "plan_id"))


def _answers(spark, sf_dir):
    results = table(spark, sf_dir, "worker_results", "result_id", "run_id", "task", "role", "ok", "output", "sources", "error", "grounded", "grounding_note").distinct()
    return results.join(table(spark, sf_dir, "tasks", "run_id", "task", "input").distinct(), ["run_id", "task"])


def answer_gates(spark, sf_dir):
    answer, source = F.col("output"), F.array_join("sources", "\n")
    return _answers(spark, sf_dir).select(
        "result_id", planning.too_short(answer).alias("short"), planning.shares_words(answer, source).alias("shares"), planning.anchored(answer, source, F.col("input")).alias("anchored")
    )


def run_summary(spark, sf_dir):
    return planning.run_totals(table(spark, sf_dir, "worker_results", "result_id", "run_id", "ok").distinct())


def run_reports(spark, sf_dir):
    return planning.merged_report(_answers(spark, sf_dir)).select("run_id", F.md5("report").alias("digest"))


def budget_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "chunks", "chunk_id", "book_id", "seq", "text").select("chunk_id", "book_id", F.struct("seq", "chunk_id").alias("ord"), mixed_tokens(F.col("text")).alias("size")).distinct()
    return planning.within_budget(rows, "book_id", "ord", "size", BUDGET).select("chunk_id", "used")


def budget_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "chunks", "chunk_id", "book_id", "text").select("chunk_id", "book_id", mixed_tokens(F.col("text")).alias("size")).distinct()
    return planning.batches(rows, "book_id", "chunk_id", "size", BUDGET)


def round_robin(spark, sf_dir):
    return planning.served(table(spark, sf_dir, "tasks", "run_id", "task", "role").distinct().withColumn("role", F.coalesce("role", F.lit("worker"))), 3)


def page_cover(spark, sf_dir):
    spans = table(spark, sf_dir, "books", "book_id", "intervals").select(F.col("book_id").alias("entity"), F.inline_outer("intervals"))
    return registry.covers(spans, PAGE).withColumnRenamed("entity", "book_id")


def error_codes(spark, sf_dir):
    return planning.code_counts(table(spark, sf_dir, "worker_results", "result_id", "error_codes").distinct())


def stub_vectors(spark, sf_dir):
    rows = _chunks(spark, sf_dir, "chunk_id", "text").where("text is not null")
    return rows.select("chunk_id", F.round(F.aggregate(stub_embedding(F.col("text")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def json_answers(spark, sf_dir):
    """Answers that are JSON, fenced or not."""
    rows = table(spark, sf_dir, "worker_results", "result_id", "output").distinct()
    return rows.select("result_id", strict_json(F.col("output")).isNotNull().alias("valid"))


def _rules_sql(column: str, rules, at: int, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce({column}, '')), '{r[0]}') THEN '{r[at]}'" for r in rules) + f" ELSE {otherwise} END"


_CLASS, _ROLE = (_rules_sql("action", HEADING_RULES, k, _rules_sql("input", BODY_RULES, k, d)) for k, d in ((1, "'explain'"), (2, "'worker'")))
_SEARCHES_SQL = "(VALUES " + ", ".join(f"('{q}', '{t}')" for q, t in SEARCHES) + ") AS s(query, asked)"
_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[0-9a-z가-힣]+')"
_TOKENS = "greatest(1, (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[\\x00-\\x7F]+', '', 'g')) + 3) // 4 + length(regexp_replace(coalesce(text, ''), '[\\x00-\\x7F]+', '', 'g')))"
_LONG = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z]{{4,}}')"
_NUMBERS = "list_transform(regexp_extract_all(coalesce({0}, ''), '[0-9]+(?:\\.[0-9]+)?'), lambda x: x::DOUBLE)"
_OUTCOME = OUTCOME.replace("'", "''")
_ANSWERS = "(SELECT DISTINCT result_id, run_id, task, w.role, ok, output, sources, error, grounded, grounding_note, input FROM (SELECT DISTINCT result_id, run_id, task, role, ok, output, sources, error, grounded, grounding_note FROM worker_results) w JOIN (SELECT DISTINCT run_id, task, input FROM tasks) t USING (run_id, task))"

_BM25_SQL = f"""
WITH docs AS (SELECT chunk_id, {_WORDS.format("text")} AS tokens FROM (SELECT DISTINCT chunk_id, text FROM chunks)),
size AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM docs),
terms AS (SELECT DISTINCT query, unnest({_WORDS.format("asked")}) AS term FROM {_SEARCHES_SQL}),
hits AS (SELECT query, term, chunk_id, len(tokens) AS length, len(list_filter(tokens, lambda t: t = term OR (length(term) >= 4 AND starts_with(t, term)))) AS tf FROM docs, terms),
df AS (SELECT term, count(DISTINCT chunk_id) AS df FROM hits WHERE tf > 0 GROUP BY 1),
scored AS (
  SELECT query, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score
  FROM hits JOIN df USING (term), size WHERE tf > 0 GROUP BY 1, 2)"""

SQL = {
    "store_stats": "SELECT book_id, count(*) AS chunks FROM (SELECT DISTINCT chunk_id, book_id FROM chunks) GROUP BY 1",
    "store_next_seq": "SELECT book_id, coalesce(max(seq), -1) + 1 AS next_seq FROM chunks GROUP BY 1",
    "store_upsert": """
SELECT DISTINCT chunk_id, book_id, coalesce(section, 'untitled') AS section FROM chunks
UNION ALL SELECT DISTINCT chunk_id || '-copy', book_id, section FROM chunks WHERE tokens > 500""",
    "dense_topk": """
WITH scored AS (
  SELECT q.vec_id AS query, c.vec_id AS chunk_id, list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 50 = 0)
SELECT query, chunk_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS place FROM scored WHERE score > 0) WHERE place <= 10""",
    "bm25_topk": _BM25_SQL
    + """
SELECT query, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS k FROM scored) WHERE k <= 20""",
    "hybrid_search": _BM25_SQL
    + f""",
lexical AS (SELECT query, chunk_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS place FROM scored),
vectors AS (SELECT DISTINCT chunk_id, vector FROM chunks WHERE len(vector) = 64),
cosines AS (SELECT query, chunk_id, list_cosine_similarity(vector, list_transform(range(1, 65), lambda i: ((i * 37) % 64) / 64.0 - 0.5)::DOUBLE[]) AS score FROM vectors, {_SEARCHES_SQL}),
dense AS (SELECT query, chunk_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS place FROM cosines WHERE score > 0 AND NOT isnan(score)),
numbers AS (SELECT * FROM (VALUES {", ".join(str(x) for x in SECTIONS.items())}) AS n(query, number)),
firsts AS (
  SELECT DISTINCT query, chunk_id FROM (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(section, '[0-9]+(?:\\.[0-9]+)+')) AS number FROM chunks WHERE section IS NOT NULL) JOIN numbers USING (number)),
fused AS (
  SELECT query, chunk_id, sum(1 / (60.0 + place)) AS score FROM (SELECT * FROM lexical WHERE place <= 30 UNION ALL SELECT * FROM dense WHERE place <= 30) GROUP BY 1, 2),
others AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS place FROM fused ANTI JOIN firsts USING (query, chunk_id))
SELECT query, chunk_id, 'primary' AS role, CAST(row_number() OVER (PARTITION BY query ORDER BY chunk_id) AS INTEGER) AS place FROM firsts
UNION ALL SELECT query, chunk_id, 'crossref', CAST(place AS INTEGER) FROM others WHERE place <= 10""",
    "section_members": r"""
WITH wanted AS (SELECT DISTINCT topic_id, book_id, trim(unnest(string_split_regex(section, '[,;]'))) AS number FROM topics WHERE section IS NOT NULL),
have AS (SELECT DISTINCT chunk_id, book_id, unnest(regexp_extract_all(section, '[0-9]+(?:\.[0-9]+)+')) AS number FROM chunks WHERE section IS NOT NULL)
SELECT DISTINCT topic_id, chunk_id FROM wanted JOIN have USING (book_id, number)""",
    "keyword_topk": f"""
WITH rows AS (
  SELECT query, chunk_id, {_WORDS.format("asked")} AS q, {_WORDS.format("section")} AS a, {_WORDS.format("text")} AS b
  FROM (SELECT DISTINCT chunk_id, section, text FROM chunks), {_SEARCHES_SQL}),
scored AS (SELECT query, chunk_id, 3 * len(list_intersect(a, q)) + len(list_intersect(b, q)) AS score FROM rows)
SELECT query, chunk_id, CAST(score AS INTEGER) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS place FROM scored WHERE score > 0) WHERE place <= 20""",
    "token_totals": f"SELECT book_id, CAST(sum({_TOKENS}) AS BIGINT) AS mixed, CAST(sum(greatest(1, (length(coalesce(text, '')) + 2) // 3)) AS BIGINT) AS thirds FROM (SELECT DISTINCT chunk_id, book_id, text FROM chunks) GROUP BY 1",
    "title_slugs": r"""
WITH rows AS (SELECT DISTINCT topic_id, title FROM topics)
SELECT topic_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(coalesce(title, ''))), '[^a-z0-9가-힣]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') AS slug,
       coalesce(nullif(regexp_replace(regexp_replace(coalesce(title, ''), '[^0-9A-Za-z가-힣_.-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'range') AS file_slug FROM rows""",
    "section_numbers": r"""
SELECT chunk_id, nullif(regexp_extract(coalesce(section, ''), '[0-9]+(?:\.[0-9]+)+'), '') AS first, CAST(len(regexp_extract_all(coalesce(section, ''), '[0-9]+(?:\.[0-9]+)+')) AS INTEGER) AS n
FROM (SELECT DISTINCT chunk_id, section FROM chunks)""",
    "discovered_sections": r"""
WITH rows AS (SELECT DISTINCT book_id, section, seq, nullif(regexp_extract(section, '[0-9]+(?:\.[0-9]+)+'), '') AS number FROM chunks WHERE section IS NOT NULL),
firsts AS (SELECT book_id, number, section AS heading FROM (SELECT *, row_number() OVER (PARTITION BY book_id, number ORDER BY seq NULLS FIRST, section) AS k FROM rows WHERE number IS NOT NULL) WHERE k = 1),
known AS (SELECT DISTINCT book_id, unnest(regexp_extract_all(section, '[0-9]+(?:\.[0-9]+)+')) AS number FROM topics WHERE section IS NOT NULL),
titled AS (SELECT *, regexp_replace(regexp_replace(heading, '^\s*[0-9]+(\.[0-9]+)*', ''), '^[ :.\-]+|[ :.\-]+$', '', 'g') AS t FROM firsts)
SELECT book_id, number, CASE WHEN t = '' THEN heading ELSE t END AS title FROM titled ANTI JOIN known USING (book_id, number)""",
    "clean_pages": r"""
SELECT path, md5(array_to_string(list_filter(list_transform(string_split_regex(markdown, '\r?\n'), lambda x: trim(regexp_replace(regexp_replace(x, '/H[0-9]+', ' ', 'g'), '\s+', ' ', 'g'))),
  lambda x: x <> '' AND NOT (starts_with(x, '#') AND NOT regexp_matches(x, '[A-Za-z0-9]'))), chr(10))) AS digest
FROM (SELECT DISTINCT path, markdown FROM parsed_books) WHERE markdown IS NOT NULL""",
    "scanned_pages": r"SELECT path, coalesce(pages > 0 AND length(regexp_replace(coalesce(markdown, ''), '^\s+|\s+$', '', 'g')) < 150 * pages, false) AS scanned FROM (SELECT DISTINCT path, markdown, pages FROM parsed_books)",
    "page_sections": r"""
WITH docs AS (SELECT DISTINCT path AS ident, markdown FROM parsed_books),
rows AS (SELECT ident, unnest(string_split_regex(coalesce(markdown, ''), '\r?\n')) AS line, generate_subscripts(string_split_regex(coalesce(markdown, ''), '\r?\n'), 1) AS pos FROM docs),
marked AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN regexp_extract(line, '^#{1,6}\s+(.+?)\s*$', 1) END AS head FROM rows),
carried AS (SELECT *, count(head) OVER w AS ord, coalesce(last_value(head IGNORE NULLS) OVER w, '') AS section FROM marked WINDOW w AS (PARTITION BY ident ORDER BY pos ROWS UNBOUNDED PRECEDING)),
bodies AS (SELECT ident, section, ord, string_agg(line, chr(10) ORDER BY pos) AS body FROM carried WHERE head IS NULL GROUP BY 1, 2, 3),
kept AS (SELECT * FROM bodies WHERE regexp_matches(body, '\S'))
SELECT ident, section, ord, md5(body) AS digest FROM kept
UNION ALL SELECT ident, '', 0, md5(markdown) FROM docs WHERE regexp_matches(coalesce(markdown, ''), '\S') AND ident NOT IN (SELECT ident FROM kept)""",
    "dollar_balance": r"SELECT chunk_id, CAST(len(regexp_extract_all(regexp_replace(text, '\\\$', '', 'g'), '\$')) AS INTEGER) AS dollars FROM (SELECT DISTINCT chunk_id, text FROM chunks) WHERE text IS NOT NULL",
    "word_signatures": r"""
SELECT chunk_id, md5(array_to_string(regexp_extract_all(regexp_replace(regexp_replace(text, '(?s)\$\$.*?\$\$', ' ', 'g'), '\$[^$\n]*\$', ' ', 'g'), '[0-9A-Za-z가-힣]+'), ' ')) AS digest
FROM (SELECT DISTINCT chunk_id, text FROM chunks) WHERE text IS NOT NULL""",
    "task_classes": f"""
WITH rows AS (SELECT DISTINCT run_id, task, action, input FROM tasks), classed AS (SELECT run_id, task, {_CLASS} AS class, {_ROLE} AS role FROM rows)
SELECT *, CASE WHEN class = 'problems' THEN 2400 WHEN role = 'coder' THEN 1400 WHEN role = 'reasoner' THEN 2000 ELSE 900 END AS budget FROM classed""",
    "answer_gates": f"""
SELECT result_id, length(regexp_replace(coalesce(output, ''), '^\\s+|\\s+$', '', 'g')) < 40 AS short,
  len(list_intersect({_LONG.format("output")}, {_LONG.format("source")})) > 0 AS shares,
  NOT regexp_matches(coalesce(input, ''), '{INTENT}') OR regexp_matches(lower(coalesce(output, '')), '{ABSENT}') OR
  len(a) = 0 OR len(list_filter(a, lambda p: len(list_filter({_NUMBERS.format("output")}, lambda q: abs(p - q) < 1e-6)) > 0)) > 0 AS anchored
FROM (SELECT *, flatten(list_transform(list_filter(string_split_regex(coalesce(source, ''), '\\r?\\n'), lambda x: regexp_matches(x, '{_OUTCOME}')), lambda x: {_NUMBERS.format("x")})) AS a
  FROM (SELECT *, array_to_string(sources, chr(10)) AS source FROM {_ANSWERS}))""",
    "run_summary": "SELECT run_id, count(*) FILTER (ok) AS ok, count(*) AS total FROM (SELECT DISTINCT result_id, run_id, ok FROM worker_results) GROUP BY 1",
    "run_reports": f"""
WITH parts AS (SELECT run_id, task, result_id, '## Task ' || task || ' · ' || coalesce(role, 'worker') || chr(10) AS head, coalesce(error, '') AS e, regexp_replace(coalesce(output, ''), '\\s+$', '') AS o,
  coalesce(grounded, true) AS g, coalesce(nullif(grounding_note, ''), 'did not reproduce source.' || chr(10)) AS note FROM {_ANSWERS}),
whole AS (SELECT *, head || coalesce(chr(10) || CASE WHEN e <> '' THEN '> ⚠️ worker failed: ' || e || chr(10) WHEN o = '' THEN NULL WHEN NOT g THEN '> 🔴 UNGROUNDED — ' || note || chr(10) || chr(10) || o || chr(10) ELSE o || chr(10) END, '') AS part FROM parts)
SELECT run_id, md5(string_agg(part, chr(10) ORDER BY task, result_id)) AS digest FROM whole GROUP BY 1""",
    "budget_prefix": f"""
WITH sized AS (SELECT chunk_id, book_id, seq, {_TOKENS} AS size FROM (SELECT DISTINCT chunk_id, book_id, seq, text FROM chunks)),
run AS (SELECT chunk_id, sum(size) OVER w AS used, row_number() OVER w AS k FROM sized WINDOW w AS (PARTITION BY book_id ORDER BY seq NULLS FIRST, chunk_id ROWS UNBOUNDED PRECEDING))
SELECT chunk_id, CAST(used AS BIGINT) AS used FROM run WHERE used <= {BUDGET} OR k = 1""",
    "round_robin": """
SELECT run_id, task, CAST((row_number() OVER (PARTITION BY run_id, role ORDER BY task) - 1) % 3 AS INTEGER) AS server
FROM (SELECT DISTINCT run_id, task, coalesce(role, 'worker') AS role FROM tasks)""",
    "page_cover": f"SELECT book_id, coalesce(bool_or(len(list_filter(intervals, lambda s: s.lo <= {PAGE} AND s.hi >= {PAGE} AND s.lo >= 1)) > 0), false) AS held FROM books GROUP BY 1",
    "error_codes": "SELECT code, count(*) AS n FROM (SELECT unnest(error_codes) AS code FROM (SELECT DISTINCT result_id, error_codes FROM worker_results)) GROUP BY 1",
    "stub_vectors": """
SELECT chunk_id, round(list_sum(list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha256(text), CAST(i * 2 + 1 AS INTEGER), 2) AS INTEGER) / 255.0)), 6) AS total
FROM (SELECT DISTINCT chunk_id, text FROM chunks) WHERE text IS NOT NULL""",
    "json_answers": r"""
SELECT result_id, coalesce(json_valid(trim(regexp_replace(regexp_replace(trim(output), '^```(?:json)?\s*', ''), '\s*```$', ''))), false) AS valid FROM (SELECT DISTINCT result_id, output FROM worker_results)""",
}

QUERIES = {
    f.__name__: f
    for f in (
        store_stats, store_next_seq, store_upsert, dense_topk, bm25_topk, hybrid_search, section_members, keyword_topk, token_totals, title_slugs, section_numbers,
        discovered_sections, clean_pages, promoted_pages, scanned_pages, page_sections, page_chunks, math_lint, dollar_balance, word_signatures, task_classes, plan_tasks,
        answer_gates, run_summary, run_reports, budget_prefix, budget_batches, round_robin, page_cover, error_codes, stub_vectors, json_answers,
    )
}
