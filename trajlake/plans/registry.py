"""Registry of runnable queries: a Spark plan and, where SQL can say it, the same result in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def r6(c: Column | str, places: int = 6) -> Column:
    """Rounded for comparison across engines; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def r(expr: str, name: str | None = None, places: int = 6) -> str:
    """The SQL twin of ``r6``."""
    return f"round({expr}, {places}) + 0.0e0" + (f" as {name}" if name else "")
