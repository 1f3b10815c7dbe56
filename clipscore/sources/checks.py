"""Reject handling shared by every source: fail on the first bad row, or set bad rows aside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_reason(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add ``reason``: the first rule (name, bad-row condition) a row breaks, or null."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(rules):
        reason = F.when(F.coalesce(bad, F.lit(True)), name).otherwise(reason)
    return df.withColumn("reason", reason)


def repeated(df: DataFrame, key: str, name: str) -> DataFrame:
    """Keys occurring more than once, as (item, reason)."""
    return (
        df.groupBy(F.col(key).alias("item"))
        .count()
        .where("count > 1")
        .select(F.col("item").cast("string"), F.lit(name).alias("reason"))
    )


def union(parts: list[DataFrame]) -> DataFrame:
    """All rows; a column that some parts lack is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def fail_if_any(violations: DataFrame, what: str) -> None:
    """Raise naming the first violation; reads at most one row."""
    bad = violations.take(1)
    if bad:
        raise ValueError(f"{what}: {', '.join(f'{k}={v}' for k, v in bad[0].asDict().items())}")


def admit(checked: DataFrame, mode: str, what: str) -> tuple[DataFrame, DataFrame]:
    """Split rows carrying ``reason`` into (good, rejects); ``mode="fail"`` raises on any reject."""
    if mode not in ("fail", "quarantine"):
        raise ValueError("mode must be 'fail' or 'quarantine'")
    rejects = checked.where(F.col("reason").isNotNull())
    if mode == "fail":
        fail_if_any(rejects, what)
    return checked.where(F.col("reason").isNull()).drop("reason"), rejects
