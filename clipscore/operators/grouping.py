"""Grouped reports over manifests, scores and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipscore.operators.ordered import HOT_ROWS, running


def running_array(values: Column) -> Column:
    """Inclusive running sum of a fixed-width array."""
    start = F.array().cast("array<double>")
    return F.aggregate(
        values,
        start,
        lambda acc, v: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + v)),
    )


def selection_counts(df: DataFrame, group: str, selected: Column, ignored: Column) -> DataFrame:
    return df.groupBy(F.col(group).alias("generator")).agg(
        F.count("*").alias("available"),
        F.count_if(selected).alias("selected"),
        F.count_if(ignored).alias("ignored"),
    )


def group_facts(df: DataFrame, group: str, real: str, spoof: str) -> DataFrame:
    """Distinct groups, distinct real groups, and the sorted synthetic family names.  Groups are
    made distinct before the names are gathered; families are the short list a report prints."""
    groups = df.select(group).distinct()
    family = F.when(F.col(group).startswith(spoof), F.substring_index(group, ":", -1))
    families = groups.agg(F.array_join(F.array_sort(F.collect_set(family)), ",").alias("f"))
    return groups.agg(
        F.count("*").alias("groups"), F.count_if(F.col(group).startswith(real)).alias("real_groups")
    ).withColumn("families", families.scalar())


def recall_per_group(rows: DataFrame, cuts: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Synthetic clips per group and the share found at each key's cutoff."""
    hit = (F.col("score") >= F.col("threshold")).cast("double")
    return (
        rows.where("label = 1")
        .join(cuts, keys)
        .groupBy(*keys, group)
        .agg(F.count("*").alias("examples"), F.avg(hit).alias("recall"))
    )


def medians(
    df: DataFrame, keys: list[str], columns: dict[str, str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact interpolating medians.

    Spark's ``median`` holds every distinct value of a key in one buffer; here the values are
    merged first and the middle one or two are read off their running counts.
    """
    out = None
    for name, column in columns.items():
        values = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("v"))
        points = values.agg(F.count("*").alias("n"))
        run = running(points, keys, ["v"], {"n": F.col("n")}, hot_rows=hot_rows)
        low, high = F.floor((F.col("n_total") + 1) / 2), F.floor(F.col("n_total") / 2) + 1

        def covers(rank: Column) -> Column:
            return (F.col("n_before") < rank) & (rank <= F.col("n_before") + F.col("n"))

        middle = run.groupBy(*keys).agg(
            (
                (F.max(F.when(covers(low), F.col("v"))) + F.max(F.when(covers(high), F.col("v")))) / 2
            ).alias(name)
        )
        out = middle if out is None else out.join(middle, keys)
    return out


def cluster_sizes(df: DataFrame, cluster: str, label: str) -> DataFrame:
    return df.groupBy(cluster).agg(
        F.count("*").alias("size"), (F.min(label) == F.max(label)).alias("one_class")
    )


def source_counts(df: DataFrame, side: str) -> DataFrame:
    """Counts by side.  Distinct groups go through a (side, group) pre-aggregate."""
    per_group = df.groupBy(side, "grp").agg(
        F.count("*").alias("n"), F.sum("label").cast("long").alias("s")
    )
    return per_group.groupBy(side).agg(
        F.sum("n").alias("clips"),
        (F.sum("n") - F.sum("s")).alias("real"),
        F.sum("s").alias("synthetic"),
        F.count("*").alias("groups"),
    )
