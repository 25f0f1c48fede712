"""The longer SQL of core queries."""

from __future__ import annotations

from quire.operators import markdown
from quire.plans.corpus import _CLASS, _ROLE, _TOKENS, BUDGET

_MACROS, _KNOWN = ("[" + ", ".join(f"'{m}'" for m in names) + "]" for names in (markdown.MACROS, markdown.KNOWN_MACROS))
_ENV = r"\\begin\{(" + "|".join(e.replace("*", r"\*") for e in markdown.ENVIRONMENTS) + r")\}"

PLAN_TASKS = rf"""
WITH rows AS (SELECT DISTINCT run_id, task, action, input FROM tasks),
tidy AS (
  SELECT run_id, task, action, array_to_string(list_filter(list_transform(string_split(coalesce(input, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS input FROM rows)
SELECT run_id AS plan_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY task) AS INTEGER) AS id, '[Task ' || task || ': ' || coalesce(action, '') || ']' AS heading, input,
  coalesce(nullif(regexp_extract(input, 'File:\s*([^\s,]+)', 1), ''), regexp_extract(input, 'function\s+[`'']?([A-Za-z_]\w*)', 1)) AS target, {_CLASS} AS action, {_ROLE} AS role FROM tidy
"""

MATH_LINT = rf"""
WITH texts AS (SELECT DISTINCT chunk_id, coalesce(text, '') AS text FROM chunks),
rows AS (SELECT chunk_id, unnest(string_split_regex(text, '\r?\n')) AS line, CAST(generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS INTEGER) AS pos FROM texts),
macros AS (SELECT chunk_id, pos, unnest(regexp_extract_all(line, '\\[a-zA-Z]+')) AS m FROM rows),
forbidden AS (SELECT unnest({_MACROS}) AS f)
SELECT chunk_id AS ident, pos AS line, 'forbidden env ''{{' || regexp_extract(line, '{_ENV}', 1) || '}}''' AS message FROM rows WHERE regexp_extract(line, '{_ENV}', 1) <> ''
UNION ALL SELECT chunk_id, pos, 'forbidden macro ''' || f || '''' FROM rows, forbidden WHERE contains(line, f)
UNION ALL SELECT chunk_id, pos, 'macro not in allowed set: ''' || m || '''' FROM macros
  WHERE NOT list_contains({_KNOWN}, m[2:]) AND m NOT IN ('\begin', '\end') AND NOT EXISTS (SELECT 1 FROM forbidden WHERE contains(m, f))
UNION ALL SELECT chunk_id, pos, 'odd number of ''$'' on line (unbalanced math)' FROM rows WHERE len(regexp_extract_all(regexp_replace(line, '\\\$', '', 'g'), '\$')) % 2 <> 0
UNION ALL SELECT chunk_id, 0, 'unbalanced ''$'' across document (net ' || n || ')' FROM (SELECT chunk_id, len(regexp_extract_all(regexp_replace(text, '\\\$', '', 'g'), '\$')) AS n FROM texts) WHERE n % 2 <> 0
"""

BUDGET_BATCHES = f"""
WITH RECURSIVE sized AS (
  SELECT book_id, chunk_id, {_TOKENS} AS size, row_number() OVER (PARTITION BY book_id ORDER BY chunk_id) AS k FROM (SELECT DISTINCT chunk_id, book_id, text FROM chunks)),
run AS (
  SELECT book_id, chunk_id, k, size AS used, 1 AS batch FROM sized WHERE k = 1
  UNION ALL
  SELECT s.book_id, s.chunk_id, s.k, CASE WHEN r.used + s.size <= {BUDGET} THEN r.used + s.size ELSE s.size END, CASE WHEN r.used + s.size <= {BUDGET} THEN r.batch ELSE r.batch + 1 END
  FROM run r JOIN sized s ON s.book_id = r.book_id AND s.k = r.k + 1)
SELECT book_id, chunk_id, batch FROM run
"""

QUERIES: dict = {}
SQL = {"plan_tasks": PLAN_TASKS, "math_lint": MATH_LINT, "budget_batches": BUDGET_BATCHES}
