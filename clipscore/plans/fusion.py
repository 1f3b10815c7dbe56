"""Nested fusion: blend weights chosen on inner out-of-fold scores, applied to outer folds that no fit has seen."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipscore.functions.scores import REAL_WEIGHT
from clipscore.operators import metrics as M
from clipscore.operators import registry as Rg
from clipscore.operators import splits
from clipscore.operators.comparison import BLEND_DECIMALS
from clipscore.operators.routing import select_weights

OUTER_SEED = 2026  # fixed value: seed of the outer folds


def cross_scores(
    df: DataFrame, makers: Mapping[str, Callable], path: str, outer: int = 5, inner: int = 3, seed: int = OUTER_SEED
) -> DataFrame:
    """Long scores (outer, fold, model, clip_id, label, grp, score) of two-level cross-fitting.

    For each outer fold one registry: its inner folds are the out-of-fold scores of the outer training
    side, its fits on all training rows score the outer fold itself (``fold`` -1).
    """
    spark = df.sparkSession
    held = splits.stratified_group_folds(df, "label", "grp", outer, seed).select("grp", F.col("fold").alias("_outer"))
    nested = splits.nested_folds(df, "label", "grp", outer, inner, seed)
    placed = df.join(held, "grp").persist()
    try:
        if specs := Rg.shareable(makers):
            _fit_together(placed, nested, specs, path, outer, inner)
        for o in range(outer):
            train, test = placed.where(F.col("_outer") != o).drop("_outer"), placed.where(F.col("_outer") == o).drop("_outer")
            folds = nested.where(F.col("outer") == o).select("grp", F.col("inner").alias("fold"))
            Rg.build(train, folds, inner, makers, f"{path}/outer={o}", test)
    finally:
        placed.unpersist()
    return read_scores(spark, path, outer)


def _fit_together(placed: DataFrame, nested: DataFrame, specs: Mapping, path: str, outer: int, inner: int) -> None:
    """The logistic models of all outer and inner folds in the same passes; the code of a set is (outer, fold)."""
    code = lambda o, fold: o * (inner + 1) + fold + 1
    of_group = nested.groupBy("grp").agg(F.collect_list(F.struct(F.col("outer").cast("int").alias("outer"), F.col("inner").cast("int").alias("inner"))).alias("_inner"))
    folds = F.array(*map(F.lit, (Rg.ALL, *range(inner))))
    trains = F.flatten(F.transform("_inner", lambda e: F.transform(F.filter(folds, lambda j: j != e["inner"]), lambda j: code(e["outer"], j))))
    own = code(F.col("_outer").cast("int"), F.lit(Rg.ALL))
    held = F.concat(F.array(own), F.transform("_inner", lambda e: code(e["outer"], e["inner"])))
    views = {s.view for s in specs.values()}
    rows = placed.join(of_group, "grp").select("clip_id", "label", "grp", *sorted(views), trains.alias("trains"), held.alias("held")).persist()
    try:
        Rg.fit_together(rows, {code(o, j): (f"{path}/outer={o}", j, specs) for o in range(outer) for j in (Rg.ALL, *range(inner))})
    finally:
        rows.unpersist()


def read_scores(spark: SparkSession, path: str, outer: int) -> DataFrame:
    parts = [Rg.Registry(f"{path}/outer={o}").scores(spark).withColumn("outer", F.lit(o)) for o in range(outer)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def paired(scores: DataFrame, clips: DataFrame, base: str, temporal: str) -> DataFrame:
    """(outer, fold, clip_id, label, base, temporal, status): the two components of a clip in one row."""
    of = [F.max(F.when(F.col("model") == m, F.col("score"))).alias(n) for m, n in ((base, "base"), (temporal, "temporal"))]
    rows = scores.where(F.col("model").isin(base, temporal)).groupBy("outer", "fold", "clip_id", "label").agg(*of)
    return rows.join(clips.select("clip_id", "status"), "clip_id")


def nested_systems(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(weights per outer fold, long scores of five systems on the outer folds).

    ``train`` holds the inner scores of every outer training side and ``test`` the outer folds, both
    keyed by ``outer``: the whole grid of all outer folds is one job.
    """
    weights = select_weights(train, ["outer"], "base", "temporal")
    rows = test.join(weights.select("outer", "temporal_weight", "metadata_weight"), "outer")
    trusted = F.col("status") == "consistent"

    def adjusted(weight):
        return F.when(trusted, F.col("base") * (1.0 - weight)).otherwise(F.col("base"))

    t = F.col("temporal_weight")
    usual = adjusted(F.lit(REAL_WEIGHT))
    systems = {
        "baseline": F.col("base"),
        "container": usual,
        "temporal": F.col("temporal"),
        "nested_fusion": t * F.col("temporal") + (1.0 - t) * adjusted(F.col("metadata_weight")),
        "fixed_fusion": 0.5 * usual + 0.5 * F.col("temporal"),
    }
    pairs = [F.struct(F.lit(n).alias("system"), F.round(e, BLEND_DECIMALS).alias("score")) for n, e in systems.items()]
    return weights, rows.select("outer", "clip_id", "label", F.inline(F.array(*pairs)))


def report(systems: DataFrame) -> DataFrame:
    """Metrics per system and outer fold, and pooled (outer -1)."""
    scoped = systems.withColumn("outer", F.explode(F.array(F.col("outer").cast("int"), F.lit(-1))))
    return M.summary(scoped, ["system", "outer"])
