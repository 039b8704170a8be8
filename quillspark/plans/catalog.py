"""Registry of named queries: a Spark plan and, where SQL can state the rule,
an independent DuckDB oracle over the same tables.

Each query is ``fn(spark, sf_dir) -> DataFrame``.  Oracle SQL reads the driver
tables as views and inlines fixture views with :func:`quillspark.fixtures.cte`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn`` under ``name`` with an optional oracle SQL text."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        queries_paths, queries_modules, queries_lines, queries_decls,
        queries_refs, queries_output, queries_links, queries_documents,
    )
