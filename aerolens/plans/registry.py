"""Query registry: Spark implementation + DuckDB oracle SQL per operator.

Keys are the operator IDs of the design inventory (lower case).  Every
query reads the driver's tables (the telemetry view over ``events``) and
works over the whole table.  Doubles are rounded half-up to 6 decimals on
both sides with the same IEEE steps; column names match exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from aerolens.sources.events_view import load_events_telemetry

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    """Half-up rounding to 6 decimals: floor(x * 1e6 + 0.5) / 1e6.

    Written with plain IEEE steps so Spark and DuckDB give identical bits
    (their built-in ``round`` break ties differently)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def tele(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_events_telemetry(spark, sf_dir)
