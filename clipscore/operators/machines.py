"""Calibrated kernel machines that differ in penalty and weighting alone: all fits of all machines share passes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipscore.operators.models import Spec, calibration_parts
from clipscore.operators.penalty import keyed_machines, keyed_sigmoids
from clipscore.session import ship

TOLERANCE = 1e-6
WHOLE = 0  # the set of all training rows; set k + 1 lacks calibration part k


def machine_scores(train: DataFrame, rows: DataFrame, specs: Sequence[Spec], folds: int = 3) -> DataFrame:
    """(clip_id, label, model, score): ``rows`` under all machines ``specs``, each the one that ``fit`` seeks on ``train``.

    The machines share view, features and calibration parts, so one pass over the training rows answers the fits on
    all of them and those without a part, under all settings; a row's random features are formed in its task, once
    a set, and kept nowhere.  The hinge is not rounded and sigmoids aim at the labels, as in ``fit``.  A class with fewer
    than two training rows is an error.
    """
    first = specs[0]
    if any(replace(s, name=first.name, c=first.c, weighting=first.weighting) != first for s in specs) or first.columns:
        raise ValueError("machines must differ in name, penalty and weighting alone, and take all columns")
    ship(train.sparkSession)
    part, sets = F.col("_part").cast("int"), F.array(*map(F.lit, range(folds + 1)))
    placed = calibration_parts(train, first, folds).select(
        "clip_id", F.col("label").cast("int"), first.view, F.filter(sets, lambda k: k != part + 1).alias("trains"), F.array(part + 1).alias("held")
    ).persist()
    try:
        settings, names = [(s.c, s.weighting) for s in specs], [float(i) for i in range(len(specs))]
        machines = keyed_machines(placed, first.view, "trains", "label", settings, names, first, TOLERANCE)
        margins = machines.margins(placed, first.view, "held", "clip_id", "label").select("c", "label", "margin").persist()
        try:
            lines = keyed_sigmoids(margins, ["c"], platt=False)
        finally:
            margins.unpersist()
    finally:
        placed.unpersist()
    scored = machines.margins(rows.withColumn("_whole", F.array(F.lit(WHOLE))), first.view, "_whole", "clip_id", "label")
    model = F.get(F.array(*[F.lit(s.name) for s in specs]), F.col("c").cast("int"))
    score = 1.0 / (1.0 + F.exp(-(F.col("a") * F.col("margin") + F.col("b"))))
    return scored.join(lines, "c").select("clip_id", "label", model.alias("model"), score.alias("score"))
