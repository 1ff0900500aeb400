"""All queries and their SQL."""

from __future__ import annotations

from . import change_queries, extract_queries, function_queries, retrieval_queries, text_queries

MODULES = [retrieval_queries, text_queries, change_queries, extract_queries, function_queries]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
