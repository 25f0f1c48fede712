"""Queries over page spans of books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.operators.spans import book_pages
from quire.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_pages(table(spark, sf_dir, "books", "book_id", "page_range", "intervals", "added_at"))


P3_SQL = r"""
WITH spans AS (
  SELECT DISTINCT book_id, s.lo AS lo, s.hi AS hi FROM (SELECT book_id, unnest(intervals) AS s FROM books)
  WHERE book_id IS NOT NULL AND s.lo >= 1 AND s.lo <= s.hi),
marked AS (
  SELECT *, max(hi) OVER (PARTITION BY book_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM spans),
numbered AS (
  SELECT *, sum(CASE WHEN top IS NULL OR lo > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM marked),
periods AS (SELECT book_id, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY book_id, run),
latest AS (
  SELECT book_id, page_range FROM (
    SELECT book_id, page_range, row_number() OVER (PARTITION BY book_id ORDER BY added_at DESC NULLS LAST, page_range DESC NULLS LAST) AS k FROM books WHERE book_id IS NOT NULL)
  WHERE k = 1),
parsed AS (
  SELECT book_id, try_cast(regexp_extract(page_range, '^\s*([0-9]{1,18})\s*[-‐‑‒–—―−]\s*([0-9]{1,18})\s*$', 1) AS BIGINT) AS a,
         try_cast(regexp_extract(page_range, '^\s*([0-9]{1,18})\s*[-‐‑‒–—―−]\s*([0-9]{1,18})\s*$', 2) AS BIGINT) AS b FROM latest),
limits AS (SELECT book_id, a, b FROM parsed WHERE a >= 1 AND a <= b),
points AS (
  SELECT book_id, lo, hi FROM periods
  UNION ALL SELECT book_id, a - 1, a - 1 FROM limits
  UNION ALL SELECT book_id, b + 1, b + 1 FROM limits),
after AS (
  SELECT book_id, max(hi) OVER (PARTITION BY book_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lo FROM points),
holes AS (SELECT book_id, before + 1 AS lo, lo - 1 AS hi FROM after WHERE lo > before + 1),
clipped AS (
  SELECT h.book_id, greatest(h.lo, coalesce(l.a, h.lo)) AS lo, least(h.hi, coalesce(l.b, h.hi)) AS hi
  FROM holes h LEFT JOIN limits l USING (book_id))
SELECT book_id, 'period' AS kind, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM periods
UNION ALL
SELECT book_id, 'gap', CAST(lo AS INTEGER), CAST(hi AS INTEGER) FROM clipped WHERE lo <= hi
"""

QUERIES = {"p3_found": p3_found}
SQL = {"p3_found": P3_SQL}
