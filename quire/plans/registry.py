"""All core queries and their SQL, by name."""

from __future__ import annotations

from quire.plans import corpus, library, longer_sql, pages
from quire.streaming import accumulate

MODULES = (corpus, library, longer_sql, pages, accumulate)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
