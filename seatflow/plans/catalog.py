"""Registered queries: one Spark plan and one DuckDB oracle per operator.

Each Spark builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole fixture views; each oracle is DuckDB text over the driver's base tables
(views inlined as CTEs).  Column names and types agree on both sides: sums
are BIGINT, money stays in cents until the last column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from seatflow.plans.fixtures import Fixtures
from seatflow.plans.oracle_views import with_views


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}

# fixed moments used by the registered queries (the clock is always an argument)
AS_OF = "1999-06-01T00:00:00Z"
PENDING_CUTOFF = "1997-01-01T00:00:00Z"
GAUGE_AT = "1999-01-01 00:00:00"


def register(name: str, sql: str | None = None, extra: dict[str, str] | None = None, recursive: bool = False):
    """Decorator: add a builder under ``name`` with its oracle text."""
    def wrap(fn):
        REGISTRY[name] = Query(name, fn, with_views(sql, extra, recursive) if sql else None)
        return fn
    return wrap


def fx(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)
