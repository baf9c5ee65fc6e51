"""All registered queries of the document-chunk engine and their DuckDB twins."""

from __future__ import annotations

from vellumspark.plans import base, search_queries, text_queries  # noqa: F401 - imported to register


def queries() -> dict:
    return base.QUERIES


def oracle_sql() -> dict[str, str]:
    return base.ORACLES
