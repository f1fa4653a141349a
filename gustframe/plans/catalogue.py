"""The registered queries and, where SQL can express them, the statements that give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gustframe.plans import catalogue_physics, catalogue_relational, catalogue_series  # noqa: F401  they register queries
from gustframe.plans.registry import QUERIES, SQL, Tables


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, path, f=f: f(Tables(spark, path))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
