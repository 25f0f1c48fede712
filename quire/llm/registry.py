"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from quire.llm.queries import QUERIES
from quire.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]
