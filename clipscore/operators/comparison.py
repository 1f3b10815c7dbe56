"""Comparing models over folds and partitions: sweeps, selection, improvement flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipscore.operators import metrics as M

# Blended scores are rounded before equal values are merged, so float noise cannot split a tie.
BLEND_DECIMALS = 12


def with_grid(df: DataFrame, name: str, values: list[float]) -> DataFrame:
    """Repeat every row for each candidate of a short grid (a literal array, not a join)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def blended(weight: Column, a: Column, b: Column) -> Column:
    return F.round(weight * a + (F.lit(1.0) - weight) * b, BLEND_DECIMALS)


def weight_sweep(
    df: DataFrame, fold_keys: list[str], first: str, second: str, weights: list[float]
) -> DataFrame:
    """Mean and worst ROC AUC over folds for each weight of ``first``."""
    grid = with_grid(df, "weight", weights)
    grid = grid.withColumn("score", blended(F.col("weight"), F.col(first), F.col(second)))
    keys = ["weight", *fold_keys]
    aucs = M.auc(M.score_curve(grid, keys), keys)
    return aucs.groupBy("weight").agg(
        F.avg("auc").alias("mean_auc"), F.min("auc").alias("worst_auc")
    )


def select_model(per_partition: DataFrame, listed: list[str] | None = None) -> DataFrame:
    """Mean minDCF and median cutoff per model over its partitions; the lowest mean is chosen, on ties the
    first of ``listed`` (without a list, of the names in order).

    The table has one row per (model, partition), a handful of each.
    """
    models = per_partition.groupBy("model").agg(
        F.avg("min_dcf").alias("mean_min_dcf"), F.median("threshold").alias("cutoff")
    )
    tie = F.col("model") if listed is None else F.array_position(F.array(*map(F.lit, listed)), F.col("model"))
    best = models.agg(F.min_by("model", F.struct(F.round("mean_min_dcf", 9), tie.alias("tie")))).scalar()
    return models.withColumn("chosen", F.col("model") == best)


def improvement(per_partition: DataFrame, candidate: str, current: str) -> DataFrame:
    """Does the candidate beat the current model in all partitions, and in which."""

    def cost(model: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col("min_dcf")))

    better = per_partition.groupBy("partition").agg(
        (cost(candidate) < cost(current)).alias("better")
    )
    flags = F.array_sort(F.collect_list(F.struct("partition", "better")))
    return better.agg(
        F.bool_and("better").alias("improved_everywhere"),
        F.array_join(F.transform(flags, lambda s: s["better"].cast("string")), ",").alias("flags"),
    )


def top_models(per_model: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` lowest-cost models per key with their place; ties keep list order (``pos``)."""
    order = Window.partitionBy(*keys).orderBy(F.round("min_dcf", 9), "pos")
    return per_model.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
