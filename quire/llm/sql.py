"""SQL of those queries that SQL can express."""

P4_FOUND = r"""
WITH latest AS (
  SELECT book_id, chunk_profile FROM (
    SELECT book_id, chunk_profile, row_number() OVER (PARTITION BY book_id ORDER BY added_at DESC NULLS LAST, chunk_profile DESC NULLS LAST) AS k FROM books WHERE book_id IS NOT NULL)
  WHERE k = 1),
records AS (
  SELECT 'chunks' AS record_table, chunk_id AS record_id, book_id, text FROM chunks
  UNION ALL SELECT 'parsed_books', path, book_id, markdown FROM parsed_books),
sized AS (
  SELECT *, length(regexp_replace(text, '[\x00-\x7F]+', '', 'g')) AS wide FROM records WHERE text IS NOT NULL AND record_id IS NOT NULL),
limits AS (
  SELECT l.book_id, p.max_tokens FROM latest l JOIN chunk_profiles p ON p.name = l.chunk_profile)
SELECT DISTINCT record_table, record_id
FROM sized s LEFT JOIN limits l USING (book_id)
WHERE greatest(1, (length(text) - wide + 3) // 4 + wide)
      > coalesce(l.max_tokens, (SELECT max_tokens FROM chunk_profiles WHERE name = 'default'))
"""

P7_FOUND = """
WITH best AS (
  SELECT book_id, coalesce(section, '') AS section, chunk_id, max(score) AS score FROM search_hits
  WHERE chunk_id IS NOT NULL AND score > 0 AND isfinite(score) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY book_id, section ORDER BY score DESC, chunk_id) AS place FROM best)
SELECT book_id, section, CAST(place AS INTEGER) AS place, chunk_id FROM ranked WHERE place <= 5
"""

P6_FOUND = r"""
WITH once AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
words AS (SELECT chunk_id, regexp_extract_all(lower(text), '[0-9a-z가-힣]+') AS w FROM once),
sets AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM words WHERE len(w) > 2),
sizes AS (SELECT chunk_id, count(*) AS n FROM sets GROUP BY 1),
common AS (SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
SELECT chunk_a, chunk_b FROM common c JOIN sizes x ON x.chunk_id = c.chunk_a JOIN sizes y ON y.chunk_id = c.chunk_b
WHERE k >= 0.6 * (x.n + y.n - k) - 1e-9
"""

SQL = {"p4_found": P4_FOUND, "p6_found": P6_FOUND, "p7_found": P7_FOUND}
