"""Shared pieces of the query catalogue: rounding on both sides, SQL text builders."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipscore.session import ship


# Added before rounding in both engines.  Averages of short decimals often lie exactly halfway
# between two rounded values, where the order of summation would decide.
NUDGE = 1.7e-8


def r6(value: Column | str) -> Column:
    """Round to 6 decimals, off the halfway points; adding zero folds a negative zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + F.lit(NUDGE), 6) + F.lit(0.0)


def s6(expression: str) -> str:
    """SQL twin of ``r6``."""
    return f"(round(CAST({expression} AS DOUBLE) + {NUDGE}, 6) + 0e0)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


class Catalog:
    """Collects (key, query, oracle SQL) triples."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, key: str, sql: str | None = None):
        def register(fn):
            if key in self.queries:
                raise KeyError(f"duplicate query key {key}")

            @wraps(fn)
            def query(spark: SparkSession, sf: str) -> DataFrame:
                ship(spark)
                return fn(spark, sf)

            self.queries[key] = query
            if sql is not None:
                self.oracles[key] = sql
            return fn

        return register
