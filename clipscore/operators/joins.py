"""Joins between manifests, views, scores and holdout records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipscore.operators.metrics import DEFAULT, Costs


def concat_views(a: DataFrame, b: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """One vector per clip: two views joined on ``clip_id`` and concatenated in order."""
    return a.join(b, "clip_id").select("clip_id", F.concat(left, right).alias(name))


def leakage(train: DataFrame, test: DataFrame, file: str, group: str) -> DataFrame:
    """Files and groups that occur on both sides, as (kind, item).  Test keys are reduced to
    distinct ones first, so a hot group meets the other side once."""

    def shared(key: str, kind: str) -> DataFrame:
        keys = test.select(key).distinct()
        return keys.join(train.select(key), key, "left_semi").select(
            F.lit(kind).alias("kind"), F.col(key).cast("string").alias("item")
        )

    return shared(file, "file").unionByName(shared(group, "group"))


def holdout_groups(rows: DataFrame, held: DataFrame, group: str) -> DataFrame:
    """Clips per recorded holdout group; groups without local clips are reported as missing."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    return (
        held.select(group)
        .distinct()
        .join(counts, group, "left")
        .select(group, F.coalesce("n", F.lit(0)).alias("clips"), F.col("n").isNull().alias("missing"))
    )


def expanded_training(
    old: DataFrame, new: DataFrame, held: DataFrame, group: str, prefix: str
) -> DataFrame:
    """Training rows of two corpora without held-out groups; the new corpus adds only groups under
    ``prefix``.  ``corpus`` says where a row came from."""
    groups = held.select(group).distinct()
    kept = old.join(groups, group, "left_anti").withColumn("corpus", F.lit("old"))
    added = new.where(F.col(group).startswith(prefix)).join(groups, group, "left_anti")
    return kept.unionByName(added.withColumn("corpus", F.lit("new")))


def with_class_weights(df: DataFrame, label: str = "label", costs: Costs = DEFAULT) -> DataFrame:
    """Row weights: ``balanced`` is n / (2 n_class); ``cost_weight`` gives real rows the odds of the
    two error costs per row of their class, synthetic rows 1."""
    counts = df.agg(
        F.struct(
            F.count_if(F.col(label) == 0).cast("double").alias("real"),
            F.count_if(F.col(label) == 1).cast("double").alias("spoof"),
        ).alias("c")
    ).scalar()
    rows = df.withColumn("_c", counts)
    real, spoof = F.col("_c.real"), F.col("_c.spoof")
    own = F.when(F.col(label) == 1, spoof).otherwise(real)
    odds = F.try_divide(costs.fa_weight * spoof, costs.miss_weight * real)
    return rows.select(
        *df.columns,
        ((real + spoof) / (2.0 * own)).alias("balanced"),
        F.when(F.col(label) == 1, 1.0).otherwise(odds).alias("cost_weight"),
    )


def class_weights(weighting: str, real: int, spoof: int, costs: Costs = DEFAULT) -> tuple[float, float]:
    """Weight of a real and of a synthetic row, as ``with_class_weights`` gives them."""
    if weighting == "cost":
        return costs.fa_weight * spoof / (costs.miss_weight * real), 1.0
    return (real + spoof) / (2.0 * real), (real + spoof) / (2.0 * spoof)


def bundle_verdict(version: int, kind: str, names: tuple[str, ...]) -> Column:
    """First mismatch of a bundle row against what the code expects, or ``ok``."""
    weight = F.col("metadata_real_weight")
    return (
        F.when(F.col("version") != version, "version")
        .when(F.col("kind") != kind, "kind")
        .when(F.col("feature_names") != F.array(*map(F.lit, names)), "names")
        .when(~((weight >= 0) & (weight <= 1)), "weight")
        .otherwise("ok")
    )


def sets_equal(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row ``equal``: do both tables hold the same set of keys."""
    marks = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        b.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sides = marks.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(F.coalesce(F.bool_and(F.expr("l = r")), F.lit(True)).alias("equal"))
