"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from slotstream.llm import queries

QUERIES = dict(queries.QUERIES)
ORACLE_SQL = dict(queries.ORACLE_SQL)
