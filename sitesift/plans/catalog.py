"""Query catalog: every registered query reads the driver tables.

``QUERIES[name] = (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
Computed columns carry the same alias on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return deco


def queries() -> dict:
    _load()
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict:
    _load()
    return {k: v[1] for k, v in QUERIES.items() if v[1] is not None}


def _load():
    # Importing the query modules fills QUERIES.
    from . import q_extract, q_links, q_process, q_report, q_scrape, q_urls  # noqa: F401
