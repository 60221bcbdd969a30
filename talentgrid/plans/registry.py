"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talentgrid.plans.fixtures import Fixtures, duckdb_ctes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF_YEAR = 2026


def query(name: str, sql: str | None = None, fixtures: tuple[str, ...] = ()):
    """Register ``fn(fixtures) -> DataFrame``; ``sql`` follows the fixture CTEs."""
    def register(fn: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            if fixtures:
                head = duckdb_ctes(*fixtures)
                body = f"{head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"{head}\n{body}"
            ORACLES[name] = body
        return fn
    return register
