"""All queries of the engine by name, with the SQL each is compared with."""

from __future__ import annotations

import importlib

MODULES = ("queries_text", "queries_urls", "queries_tables", "queries_flow", "queries_reports", "queries_scale", "queries_sources")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame and, where SQL can say it, the same rows in SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")


def queries() -> dict:
    _load()
    return dict(sorted(QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(sorted(ORACLES.items()))
