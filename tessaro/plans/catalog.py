"""Registered queries and the SQL that DuckDB runs to check them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


from tessaro.plans import file_queries, json_queries, parsing_queries, retrieval_queries, search_queries, sheet_queries, store_queries, table_queries, write_queries  # noqa: E402, F401
