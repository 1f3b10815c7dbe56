"""Nested choice of the kernel machine's penalty, against a fixed blend on the same outer folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipscore.functions.scores import container_adjusted
from clipscore.operators import metrics as M
from clipscore.operators import models as Mo
from clipscore.operators import registry as Rg
from clipscore.operators import splits
from clipscore.operators.ordered import ranked
from clipscore.operators.penalty import keyed_paths, keyed_sigmoids
from clipscore.plans.fusion import OUTER_SEED

WHOLE = -1  # as an outer fold: all rows are training rows; as an inner fold or a part: none is left out
PARTS = 3  # of a training set, whose left-out margins calibrate its machine


def training_sets(df: DataFrame, outer: int, inner: int, seed: int) -> DataFrame:
    """``df`` with the sets that a row trains (``trains``) and those that score it (``held``), as codes of
    (outer, inner, part).

    A set is an outer training side without one inner fold and without one calibration part.  All rows as
    training side (outer ``WHOLE``) have ``outer`` inner folds: they choose the penalty to be deployed.
    """
    held = splits.stratified_group_folds(df, "label", "grp", outer, seed).select("grp", F.col("fold").alias("_outer"))
    sides = held.select("grp", F.lit(WHOLE).alias("outer"), F.col("_outer").alias("inner"))
    if inner:
        sides = sides.unionByName(splits.nested_folds(df, "label", "grp", outer, inner, seed).select("grp", "outer", "inner"))
    entry = F.struct(F.col("outer").cast("int").alias("outer"), F.col("inner").cast("int").alias("inner"))
    of_group = sides.groupBy("grp").agg(F.collect_list(entry).alias("_inner"))
    hashed = df.select("clip_id", "label").withColumn("_h", F.xxhash64(F.lit(seed), "clip_id"))
    parts = ranked(hashed, ["label"], ["_h", "clip_id"], "_rn").select("clip_id", F.pmod("_rn", F.lit(PARTS)).cast("int").alias("_part"))
    placed = df.join(held, "grp").join(of_group, "grp").join(parts, "clip_id")

    def code(o: str, i: str, p: str) -> str:
        return f"CAST(({o} + 1) * 10000 + ({i} + 1) * 10 + {p} + 1 AS INT)"

    # A set that leaves out no inner fold is the refit for the outer fold; all rows together need none here.
    others = f"filter(sequence(IF(e.outer = {WHOLE}, 0, {WHOLE}), IF(e.outer = {WHOLE}, {outer}, {inner}) - 1), j -> j <> e.inner)"
    trains = f"flatten(transform(_inner, e -> flatten(transform({others}, j -> transform(filter(sequence({WHOLE}, {PARTS - 1}), p -> p <> _part), p -> {code('e.outer', 'j', 'p')})))))"
    left = f"flatten(transform(_inner, e -> concat(array({code('e.outer', 'e.inner', str(WHOLE))}), transform({others}, j -> {code('e.outer', 'j', '_part')}))))"
    own = f"array({code('_outer', str(WHOLE), str(WHOLE))})"
    return placed.withColumns({"trains": F.expr(trains), "held": F.expr(f"concat({left}, {own})" if inner else left)}).drop("_inner", "_part")


def path_scores(df: DataFrame, spec: Mo.Spec, cs: Sequence[float], path: str, outer: int, inner: int, seed: int = OUTER_SEED) -> DataFrame:
    """(clip_id, label, outer, inner, c, score): calibrated scores of all machines on rows that they have not seen.

    ``inner`` is the inner fold that a machine scores, ``WHOLE`` where it scores the outer fold itself.
    """
    placed = training_sets(df, outer, inner, seed).withColumn("label", F.col("label").cast("int")).persist()
    try:
        paths = keyed_paths(placed, spec.view, "trains", "label", cs, spec)
        paths.margins(placed, spec.view, "held", "clip_id", "label").write.mode("overwrite").parquet(f"{path}/margins")
    finally:
        placed.unpersist()
    key = F.col("key")
    names = {"outer": (key / 10_000).cast("int") - 1, "inner": ((key % 10_000) / 10).cast("int") - 1, "part": key % 10 - 1}
    margins = df.sparkSession.read.parquet(f"{path}/margins").withColumns(names)
    keys = ["outer", "inner", "c"]
    calibration = margins.where(F.col("part") != WHOLE).select(*keys, "label", "margin").persist()
    try:
        lines = keyed_sigmoids(calibration, keys)
    finally:
        calibration.unpersist()
    scored = margins.where(F.col("part") == WHOLE).join(lines, keys)
    score = 1 / (1 + F.exp(-(F.col("a") * F.col("margin") + F.col("b"))))
    return scored.select("clip_id", "label", *keys, score.alias("score"))


def penalty_costs(scores: DataFrame) -> DataFrame:
    """(outer, c, min_dcf) of the pooled inner scores."""
    return M.min_dcf(scores.where(F.col("inner") != WHOLE), ["outer", "c"]).select("outer", "c", "min_dcf")


def choose_penalties(scores: DataFrame) -> DataFrame:
    """(outer, c, inner_min_dcf): the penalty with the lowest pooled inner cost, the smaller one on ties."""
    cost = F.round("min_dcf", 12).alias("min_dcf")
    best = penalty_costs(scores).groupBy("outer").agg(F.min(F.struct(cost, "c")).alias("m"))
    return best.select("outer", F.col("m.c").alias("c"), F.col("m.min_dcf").alias("inner_min_dcf"))


def nested_penalty(
    df: DataFrame, spec: Mo.Spec, path: str, cs: Sequence[float] = Mo.SVM_CS, outer: int = 5, inner: int = 3, seed: int = OUTER_SEED
) -> tuple[DataFrame, DataFrame]:
    """(chosen penalties, long scores of two systems on the outer folds).

    ``df`` has a container ``status``; scores are adjusted by it before penalties are chosen, as the final ones
    are.  ``tuned`` takes its penalty from the outer training side alone; ``fixed`` is three quarters of the
    machine at penalty 1, which the same path holds, and a quarter of a logistic model.  The penalty of outer
    ``WHOLE`` is the one to refit on all rows.
    """
    spark = df.sparkSession
    status = df.select("clip_id", "status")
    raw = path_scores(df, spec, sorted({*cs, 1.0}), path, outer, inner, seed).join(status, "clip_id")
    adjusted = raw.withColumn("score", container_adjusted(F.col("score"), F.col("status")))
    adjusted.write.mode("overwrite").parquet(f"{path}/scores")
    scores = spark.read.parquet(f"{path}/scores")
    chosen = choose_penalties(scores.where(F.col("c").isin(list(map(float, cs)))))
    tests = scores.where((F.col("inner") == WHOLE) & (F.col("outer") != WHOLE))
    tuned = tests.join(chosen.select("outer", "c"), ["outer", "c"])
    logistic = Mo.Spec("logistic", "logistic", spec.view, 0.1)
    folds = splits.stratified_group_folds(df, "label", "grp", outer, seed).select("grp", "fold")
    made = Rg.build(df.drop("status"), folds, outer, {"logistic": Mo.Maker(logistic)}, f"{path}/logistic")
    other = made.out_of_fold(spark).join(status, "clip_id")
    other = other.select("clip_id", container_adjusted(F.col("score"), F.col("status")).alias("_other"))
    fixed = tests.where(F.col("c") == 1.0).join(other, "clip_id").withColumn("score", 0.75 * F.col("score") + 0.25 * F.col("_other"))
    columns = ["outer", "clip_id", "label", "score"]
    systems = tuned.select(F.lit("tuned").alias("system"), *columns).unionByName(fixed.select(F.lit("fixed").alias("system"), *columns))
    return chosen, systems
