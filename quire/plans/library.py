"""Queries of registry, context, gates and notes over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import slug
from quire.operators import context, gates, markdown, notes, planning, registry
from quire.operators.answers import requested_count
from quire.operators.spans import coalesce_spans, latest_range
from quire.session import table
from quire.sources.routing import routed

PART = "examples"


def _books(spark, sf_dir, *columns):
    return table(spark, sf_dir, "books", *columns).where("book_id is not null")


def _spans(books):
    return books.select(F.col("book_id").alias("entity"), F.inline("intervals")).where("lo >= 1 and lo <= hi")


def topic_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "topics", "topic_id", "book_id", "status", "kind", "created_at").distinct()
    return registry.topics_of(rows, status="todo", kind="exam").select("topic_id", "book_id", "created_at")


def book_filter(spark, sf_dir):
    """Chunks of the unnamed section, in order."""
    return registry.chunks_of(table(spark, sf_dir, "chunks", "chunk_id", "book_id", "section", "seq").distinct(), section="").select("chunk_id", "book_id", "seq")


def registry_merge(spark, sf_dir):
    """Topics after those of failed books were set back to todo and others marked as reviewed."""
    topics = table(spark, sf_dir, "topics", "topic_id", "book_id", "status", "kind").distinct()
    failed = _books(spark, sf_dir, "book_id", "status").where("status = 'failed'").select("book_id").distinct()
    back = topics.join(failed, "book_id", "left_semi").withColumn("status", F.lit("todo"))
    done = topics.join(failed, "book_id", "left_anti").where("status = 'draft'").withColumn("status", F.lit("review"))
    changes = back.unionByName(done).select(topics.columns)
    return registry.merged(topics, changes.unionByName(changes), "topic_id").select("topic_id", "status", "kind")


def topics_added(spark, sf_dir):
    """Topics of the sections found in chunks, by title, where no topic has that id."""
    topics = table(spark, sf_dir, "topics", "topic_id", "book_id", "subject", "title", "kind", "section", "status").distinct()
    found = registry.discovered(table(spark, sf_dir, "chunks", "book_id", "section", "seq").distinct(), topics)
    new = found.select(slug(F.concat_ws("-", "book_id", "number")).alias("topic_id"), "book_id", "title", F.lit("exam").alias("kind"), F.col("number").alias("section"))
    return registry.added(topics, new, table(spark, sf_dir, "books", "book_id", "subject")).groupBy("book_id").agg(F.count("*").alias("topics"), F.count_if(F.col("status") == "todo").alias("todo"))


def books_removed(spark, sf_dir):
    """Rows that stay in each table when the failed books are removed everywhere."""
    tables = {n: table(spark, sf_dir, n, "book_id") for n in ("books", "topics", "chunks", "search_hits")}
    left = registry.without_books(tables, _books(spark, sf_dir, "book_id", "status").where("status = 'failed'"))
    counts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def status_counts(spark, sf_dir):
    return registry.status_counts(table(spark, sf_dir, "topics").distinct())


def batch_summary(spark, sf_dir):
    """Books of each source that were taken in, left open or failed."""
    rows = table(spark, sf_dir, "books", "book_id", "source", "status", "added_at").distinct()
    s = F.col("status")
    return rows.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count_if(s == "indexed").alias("ingested"), F.count_if(s.isin("pending", "indexing")).alias("open"), F.count_if(s == "failed").alias("failed"))


def pending_pages(spark, sf_dir):
    """Pages of the range of each book that it does not hold."""
    books = _books(spark, sf_dir, "book_id", "intervals", "page_range", "added_at")
    asked = latest_range(books).select("entity", F.col("first").alias("lo"), F.col("last").alias("hi"))
    return registry.missing_spans(_spans(books), asked).select(F.col("entity").alias("book_id"), "lo", "hi")


def accumulate_spans(spark, sf_dir):
    """What each book holds when the ranges asked for are added to its spans, and how many pages are new."""
    books = _books(spark, sf_dir, "book_id", "intervals", "page_range", "added_at")
    asked = latest_range(books).select("entity", F.col("first").alias("lo"), F.col("last").alias("hi"))
    new = registry.missing_spans(_spans(books), asked)
    after = coalesce_spans(_spans(books).select("entity", "lo", "hi").unionByName(new)).where("kind = 'period'")
    pages = after.groupBy("entity").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("held"), F.count("*").alias("spans"))
    fresh = new.groupBy("entity").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("new"))
    return pages.join(fresh, "entity", "left").select(F.col("entity").alias("book_id"), "held", "spans", F.coalesce("new", F.lit(0)).alias("new"))


def parser_routes(spark, sf_dir):
    """The parser of each parsed file: of its book's latest row, else by extension."""
    latest = _books(spark, sf_dir, "book_id", "parser", "added_at").groupBy("book_id").agg(F.max(F.struct("added_at", "parser")).getField("parser").alias("parser"))
    files = table(spark, sf_dir, "parsed_books", "path", "book_id").distinct()
    return routed(files.join(latest, "book_id", "left").select("path", "parser")).select("path", "parser", "error")


def part_order(spark, sf_dir):
    rows = table(spark, sf_dir, "chunks", "chunk_id", "book_id", "section", "text").select("chunk_id", F.concat_ws("\t", F.coalesce("book_id", F.lit("")), F.coalesce("section", F.lit(""))).alias("group"), "text").distinct()
    return context.part_order(rows, "group", "chunk_id", "text", PART).select("chunk_id", "place")


def marker_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "chunks", "chunk_id", "text")
    return rows.select("chunk_id", context.marker_count(F.col("text"), "Example").alias("markers"), context.part_score(F.col("text"), "practice").alias("score")).distinct()


def _run_outputs(spark, sf_dir):
    rows = table(spark, sf_dir, "worker_results", "result_id", "run_id", "task", "output").distinct().where("output is not null")
    return rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("task", "result_id", "output"))).alias("rows"))


def numbered_passages(spark, sf_dir):
    rows = _run_outputs(spark, sf_dir)
    return rows.select("run_id", F.md5(context.numbered(F.transform("rows", lambda r: F.regexp_replace(r["output"], r"^\s+|\s+\z", "")), F.col("run_id"))).alias("digest"))


def context_blocks(spark, sf_dir):
    """Outputs of a run as a context of at most 6,000 characters."""
    rows = _run_outputs(spark, sf_dir)
    source = F.transform("rows", lambda r: F.struct(r["task"].cast("string").alias("source"), F.lit("").alias("section"), F.regexp_replace(r["output"], r"^\s+|\s+\z", "").alias("text")))
    return rows.select("run_id", F.md5(context.context_block(source)).alias("digest"))


def front_matter(spark, sf_dir):
    rows = table(spark, sf_dir, "topics", "topic_id", "book_id", "title", "section").distinct()
    return rows.select("topic_id", context.front_matter(title=F.col("title"), book=F.col("book_id"), scope=F.col("section")).alias("head"))


def lexical_gates(spark, sf_dir):
    rows = table(spark, sf_dir, "worker_results", "result_id", "sources", "output").distinct()
    return rows.select("result_id", gates.lexical(F.col("output"), F.filter("sources", lambda s: s.isNotNull())).alias("reason"))


def problem_gates(spark, sf_dir):
    results = table(spark, sf_dir, "worker_results", "result_id", "run_id", "task", "sources", "output").distinct()
    asked = table(spark, sf_dir, "tasks", "run_id", "task", "input").distinct()
    return results.join(asked, ["run_id", "task"]).select("result_id", gates.problem_set(F.col("input"), F.col("output"), F.col("sources")).alias("reason"))


def question_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "tasks", "run_id", "task", "role", "action", "input").distinct()
    kind = gates.category(F.col("input"), F.lit(""))
    return rows.select("run_id", "task", kind.alias("kind"), requested_count(F.col("input")).alias("asked"), planning.default_role(F.col("action")).alias("role"))


def judge_verdicts(spark, sf_dir):
    """Verdicts read from replies made of what judges gave."""
    rows = table(spark, sf_dir, "worker_results", "result_id", "grounded", "grounding_note", "error_codes").distinct()
    reply = F.to_json(F.struct("grounded", F.col("grounding_note").alias("reason"), "error_codes"))
    v = gates.verdict(reply)
    return rows.select("result_id", v["ok"].alias("ok"), v["reason"].alias("reason"), F.array_join(v["error_codes"], ",").alias("codes"))


def number_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "worker_results", "result_id", "output").distinct()
    n = gates.unique_numbers(F.col("output"))
    return rows.select("result_id", F.size(n).alias("n"), F.round(F.aggregate(n, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def bank_counts(spark, sf_dir):
    return notes.bank_counts(table(spark, sf_dir, "parsed_books", "path", "markdown").distinct(), "path", "markdown")


def bank_verdicts(spark, sf_dir):
    return notes.bank_verdicts(bank_counts(spark, sf_dir))


def figure_sections(spark, sf_dir):
    """Notes of topics with the chunks of their sections in the place of figures."""
    topics = table(spark, sf_dir, "topics", "topic_id", "book_id", "title", "section").distinct()
    figures = table(spark, sf_dir, "chunks", "chunk_id", "book_id", "section", "seq").distinct().withColumnRenamed("chunk_id", "fig_id")
    held = notes.figures_of(topics, figures).groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("fig_id", "book_id", F.concat("fig_id", F.lit(".png")).alias("path"), F.lit("").alias("caption"), F.col("seq").alias("page")))).alias("figures"))
    note = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n"))
    return topics.join(held, "topic_id", "left").select("topic_id", F.md5(notes.with_figures(note, F.col("figures"))).alias("digest"))


def math_guard(spark, sf_dir):
    """Chunks with their TeX brackets as dollars, where that keeps all words and renders."""
    rows = table(spark, sf_dir, "chunks", "chunk_id", "text").where("text is not null").distinct().withColumn("candidate", markdown.dollar_math(F.col("text")))
    return markdown.guarded_math(rows, "chunk_id", "text", "candidate").select(F.col("ident").alias("chunk_id"), "reason", F.length("text").alias("length"))


def visible_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "worker_results", "result_id", "output").distinct().where("output is not null")
    return rows.select("result_id", F.md5(markdown.without_nested_thinking(F.col("output"))).alias("digest"))


_PAGES = r"""
WITH latest AS (
  SELECT book_id, page_range FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY added_at DESC NULLS LAST, page_range DESC NULLS LAST) AS k FROM books WHERE book_id IS NOT NULL) WHERE k = 1),
parsed AS (
  SELECT book_id, TRY_CAST(regexp_extract(page_range, '^\s*([0-9]{1,18})\s*[-‐‑‒–—―−]\s*([0-9]{1,18})\s*$', 1) AS BIGINT) AS a,
         TRY_CAST(regexp_extract(page_range, '^\s*([0-9]{1,18})\s*[-‐‑‒–—―−]\s*([0-9]{1,18})\s*$', 2) AS BIGINT) AS b FROM latest),
asked AS (SELECT book_id, unnest(range(a, b + 1)) AS page FROM parsed WHERE a >= 1 AND a <= b),
spans AS (SELECT DISTINCT book_id, s.lo AS lo, s.hi AS hi FROM (SELECT book_id, unnest(intervals) AS s FROM books WHERE book_id IS NOT NULL) WHERE s.lo >= 1 AND s.lo <= s.hi),
held AS (SELECT DISTINCT book_id, unnest(range(lo, hi + 1)) AS page FROM spans),
fresh AS (SELECT * FROM asked EXCEPT SELECT * FROM held)"""
_FAILED = "(SELECT DISTINCT book_id FROM books WHERE status = 'failed' AND book_id IS NOT NULL)"
_COUNT = "(length({0}) - length(replace({0}, '{1}', ''))) // {2}"
_SCORE = lambda part: " + ".join(_COUNT.format("lower(coalesce(text, ''))", w, len(w)) for w in context.PART_WORDS[part])
_TRIMMED = r"regexp_replace(output, '^\s+|\s+$', '', 'g')"
_LONG = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z]{{4,}}')"

SQL = {
    "topic_filter": "SELECT DISTINCT topic_id, book_id, created_at FROM topics WHERE status = 'todo' AND kind = 'exam'",
    "book_filter": "SELECT DISTINCT chunk_id, book_id, seq FROM chunks WHERE section = ''",
    "registry_merge": f"""
SELECT DISTINCT topic_id, CASE WHEN book_id IN {_FAILED} THEN 'todo' WHEN status = 'draft' THEN 'review' ELSE status END AS status, kind FROM topics""",
    "books_removed": "SELECT name, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS name, book_id FROM {n}" for n in ("books", "topics", "chunks", "search_hits"))
    + f") WHERE book_id IS NULL OR book_id NOT IN {_FAILED} GROUP BY 1",
    "status_counts": "SELECT status, count(*) AS n FROM (SELECT DISTINCT * FROM topics) GROUP BY 1",
    "batch_summary": """
SELECT coalesce(source, '') AS source, count(*) FILTER (status = 'indexed') AS ingested, count(*) FILTER (status IN ('pending', 'indexing')) AS open, count(*) FILTER (status = 'failed') AS failed
FROM (SELECT DISTINCT book_id, source, status, added_at FROM books) GROUP BY 1""",
    "pending_pages": _PAGES
    + """
SELECT book_id, min(page) AS lo, max(page) AS hi FROM (SELECT *, page - row_number() OVER (PARTITION BY book_id ORDER BY page) AS run FROM fresh) GROUP BY book_id, run""",
    "accumulate_spans": _PAGES
    + """,
after AS (SELECT book_id, page FROM held UNION SELECT book_id, page FROM fresh),
runs AS (SELECT *, page - row_number() OVER (PARTITION BY book_id ORDER BY page) AS run FROM after)
SELECT book_id, count(*) AS held, count(DISTINCT run) AS spans, (SELECT count(*) FROM fresh f WHERE f.book_id = r.book_id) AS new FROM runs r GROUP BY book_id""",
    "parser_routes": r"""
WITH latest AS (SELECT book_id, parser FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY added_at DESC NULLS LAST, parser DESC NULLS LAST) AS k FROM books WHERE book_id IS NOT NULL) WHERE k = 1),
chosen AS (
  SELECT path, coalesce(parser, CASE lower(regexp_extract(coalesce(path, ''), '\.([A-Za-z0-9]+)$', 1)) WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'pdf' THEN 'fast' END) AS parser
  FROM (SELECT DISTINCT path, book_id FROM parsed_books) LEFT JOIN latest USING (book_id))
SELECT path, parser, CASE WHEN parser IS NULL THEN 'cannot infer parser for ' || coalesce(path, 'null') WHEN parser NOT IN ('text', 'fast', 'docling') THEN 'unknown parser profile ' || parser END AS error FROM chosen""",
    "part_order": f"""
WITH rows AS (SELECT DISTINCT chunk_id, coalesce(book_id, '') || chr(9) || coalesce(section, '') AS g, text FROM chunks),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY chunk_id) AS k, count(*) OVER (PARTITION BY g) AS n, {_SCORE(PART)} AS score FROM rows),
led AS (SELECT *, k <= greatest(1, least(n, greatest(2, n // 5))) AS lead FROM ranked)
SELECT chunk_id, CAST(row_number() OVER (PARTITION BY g ORDER BY lead DESC, CASE WHEN lead THEN k END, score DESC, k) AS INTEGER) AS place FROM led""",
    "marker_counts": f"SELECT DISTINCT chunk_id, CAST({_COUNT.format("coalesce(text, '')", 'Example ', 8)} AS INTEGER) AS markers, CAST({_SCORE('practice')} AS INTEGER) AS score FROM chunks",
    "numbered_passages": rf"""
WITH rows AS (SELECT run_id, trim('[' || row_number() OVER (PARTITION BY run_id ORDER BY task, result_id, output) || '] ' || {_TRIMMED}, ' ') AS part, row_number() OVER (PARTITION BY run_id ORDER BY task, result_id, output) AS k
  FROM (SELECT DISTINCT result_id, run_id, task, output FROM worker_results) WHERE output IS NOT NULL)
SELECT run_id, md5(coalesce('## ' || run_id || chr(10) || chr(10), '') || string_agg(part, chr(10) || chr(10) ORDER BY k)) AS digest FROM rows GROUP BY run_id""",
    "front_matter": """
SELECT DISTINCT topic_id, '---' || chr(10) || concat_ws(chr(10), 'title: ' || title, 'book: ' || book_id, 'scope: ' || section) || chr(10) || '---' || chr(10) AS head FROM topics""",
    "lexical_gates": rf"""
SELECT result_id, CASE WHEN coalesce(len(list_filter(sources, lambda s: s IS NOT NULL)), 0) = 0 THEN 'free' WHEN length(regexp_replace(coalesce(output, ''), '^\s+|\s+$', '', 'g')) < 40 THEN 'short'
  WHEN len(list_intersect({_LONG.format("output")}, flatten(list_transform(list_filter(sources, lambda s: s IS NOT NULL), lambda s: {_LONG.format("s")})))) > 0 THEN 'words' ELSE 'off-topic' END AS reason
FROM (SELECT DISTINCT result_id, sources, output FROM worker_results)""",
    "question_kinds": rf"""
SELECT run_id, task, CASE WHEN regexp_matches(lower(coalesce(input, '')), '{gates.INDEX}') THEN 'index' WHEN regexp_matches(lower(coalesce(input, '')), '{gates.CHOICE}') THEN 'bool' ELSE 'value' END AS kind,
  coalesce(CASE WHEN regexp_matches(lower(coalesce(input, '')), '\d+\s*(?:problems|exercises|questions|문제)') THEN greatest(1, TRY_CAST(regexp_extract(lower(coalesce(input, '')), '(\d+)\s*(?:problems|exercises|questions|문제)', 1) AS INTEGER)) END,
    CASE WHEN regexp_matches(lower(coalesce(input, '')), '\btwo\b|두\s*문제') THEN 2 WHEN regexp_matches(lower(coalesce(input, '')), '\bthree\b|세\s*문제') THEN 3 ELSE 1 END) AS asked,
  CASE WHEN lower(trim(action)) IN ('proof', 'derive', 'deep') THEN 'reasoner' WHEN lower(trim(action)) IN ('code', 'fix', 'review') THEN 'coder' ELSE 'worker' END AS role
FROM (SELECT DISTINCT run_id, task, role, action, input FROM tasks)""",
    "judge_verdicts": """
SELECT result_id, coalesce(grounded, false) AS ok, coalesce(grounding_note, '') AS reason, coalesce(array_to_string(error_codes, ','), '') AS codes
FROM (SELECT DISTINCT result_id, grounded, grounding_note, error_codes FROM worker_results)""",
    "number_sets": r"""
SELECT result_id, CAST(len(n) AS INTEGER) AS n, round(coalesce(list_sum(n), 0.0), 4) AS total
FROM (SELECT result_id, list_distinct(list_transform(regexp_extract_all(coalesce(output, ''), '\d+(?:\.\d+)?'), lambda x: round(x::DOUBLE, 6))) AS n FROM (SELECT DISTINCT result_id, output FROM worker_results))""",
    "figure_sections": r"""
WITH t AS (SELECT DISTINCT topic_id, book_id, title, section FROM topics),
wanted AS (SELECT DISTINCT topic_id, book_id, trim(unnest(string_split_regex(section, '[,;]'))) AS number FROM t WHERE section IS NOT NULL),
have AS (SELECT DISTINCT chunk_id, book_id, seq, unnest(regexp_extract_all(section, '[0-9]+(?:\.[0-9]+)+')) AS number FROM chunks WHERE section IS NOT NULL),
held AS (SELECT DISTINCT topic_id, chunk_id, book_id, seq FROM wanted JOIN have USING (book_id, number)),
shown AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY chunk_id) AS k FROM held),
body AS (SELECT topic_id, string_agg('![' || chunk_id || '](' || chunk_id || '.png)' || chr(10) || '*Figure ' || k || '.*' || coalesce(chr(10) || '*(source: ' || book_id || ', p.' || seq || ')*', ''), chr(10) || chr(10) ORDER BY k) AS b FROM shown GROUP BY 1)
SELECT topic_id, md5('# ' || coalesce(title, '') || CASE WHEN b IS NULL THEN chr(10) ELSE chr(10) || chr(10) || '## Figures' || chr(10) || chr(10) || b || chr(10) END) AS digest FROM t LEFT JOIN body USING (topic_id)""",
    "bank_counts": r"""
WITH docs AS (SELECT DISTINCT path AS ident, markdown FROM parsed_books),
rows AS (SELECT ident, unnest(string_split_regex(coalesce(markdown, ''), '\r?\n')) AS line, generate_subscripts(string_split_regex(coalesce(markdown, ''), '\r?\n'), 1) AS pos FROM docs),
heads AS (SELECT *, nullif(lower(trim(regexp_extract(line, '^#{3,4}\s+(.+)$', 1))), '') AS h FROM rows),
named AS (SELECT *, CASE WHEN regexp_matches(h, 'basic|기초|기본') THEN 'basic' WHEN regexp_matches(h, 'intermediate|중급') THEN 'intermediate' WHEN regexp_matches(h, 'advanced|고급') THEN 'advanced' ELSE h END AS level FROM heads),
carried AS (SELECT *, last_value(level IGNORE NULLS) OVER (PARTITION BY ident ORDER BY pos ROWS UNBOUNDED PRECEDING) AS held FROM named)
SELECT ident, held AS level, count(*) FILTER (level IS NULL AND regexp_matches(trim(line), '^\d+[.)]\s')) AS n FROM carried WHERE held IS NOT NULL GROUP BY 1, 2""",
    "visible_answers": r"SELECT result_id, md5(regexp_replace(output, '^\s+|\s+$', '', 'g')) AS digest FROM (SELECT DISTINCT result_id, output FROM worker_results) WHERE output IS NOT NULL AND NOT contains(output, 'think>')"
    r" UNION ALL SELECT result_id, md5(regexp_replace(regexp_replace(regexp_replace(output, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', '', 'g'), '^\s+|\s+$', '', 'g')) FROM (SELECT DISTINCT result_id, output FROM worker_results) WHERE contains(output, 'think>')",
}
SQL["bank_verdicts"] = "WITH counts AS (" + SQL["bank_counts"] + """),
held AS (SELECT ident, coalesce(sum(n) FILTER (level = 'basic'), 0) AS b, coalesce(sum(n) FILTER (level = 'intermediate'), 0) AS i, coalesce(sum(n) FILTER (level = 'advanced'), 0) AS a FROM counts GROUP BY 1)
SELECT ident, CASE WHEN b <> 10 THEN 'basic: got ' || CAST(b AS BIGINT) || ', want 10' WHEN i <> 5 THEN 'intermediate: got ' || CAST(i AS BIGINT) || ', want 5' WHEN a <> 5 THEN 'advanced: got ' || CAST(a AS BIGINT) || ', want 5' ELSE '' END AS issue FROM held"""

QUERIES = {
    f.__name__: f
    for f in (
        topic_filter, book_filter, registry_merge, topics_added, books_removed, status_counts, batch_summary, pending_pages, accumulate_spans, parser_routes, part_order,
        marker_counts, numbered_passages, context_blocks, front_matter, lexical_gates, problem_gates, question_kinds, judge_verdicts, number_sets, bank_counts,
        bank_verdicts, figure_sections, math_guard, visible_answers,
    )
}
