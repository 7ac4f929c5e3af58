"""Queries of the library's own operators and their DuckDB SQL."""

from __future__ import annotations

from . import documents, layout, pages, rules, sequence_sql, strings, tracking

_PARTS = (tracking, strings, layout, documents, pages, rules)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL = {k: v for part in (*_PARTS, sequence_sql) for k, v in part.ORACLE_SQL.items()}
