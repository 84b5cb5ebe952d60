"""All core queries and the SQL they are held against."""

from __future__ import annotations

from . import detail_queries, edit_queries, problems, report_queries

QUERIES = {**report_queries.QUERIES, **detail_queries.QUERIES, **edit_queries.QUERIES, **problems.QUERIES}
SQL: dict[str, str] = {**edit_queries.SQL, **problems.SQL}
