"""All queries of the library outside llm, with the SQL that states their results."""

from __future__ import annotations

from . import content, documents, logs, scalars, stores, streams, trees

PARTS = (content, logs, stores, trees, scalars, documents, streams)


def queries() -> dict:
    return {k: v for p in PARTS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in PARTS for k, v in p.SQL.items()}
