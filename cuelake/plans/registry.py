"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import chunk_queries, decode_queries, frame_queries, numeric_queries, signal_queries, speech_queries, spoken_queries, text_queries

_PARTS = (speech_queries, text_queries, numeric_queries, chunk_queries, frame_queries, decode_queries, signal_queries, spoken_queries)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
