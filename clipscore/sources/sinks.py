"""Prediction, explanation, report, split and out-of-fold sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipscore.functions.scores import in_unit, label_text
from clipscore.sources import checks

OOF_DECIMALS = 8


def score_text(score: Column, decimals: int = 6) -> Column:
    """Fixed-point text of a score in [0, 1], rounding the exact binary value (ties to even).

    ``format_string`` rounds the shortest decimal text of the double half up, which differs on
    scores like 0.6590625.  Here the score is split into two halves whose products with 2*10^d are
    exact, so the sign of the distance to the midpoint is exact as well.
    """
    scale = 10**decimals
    low = F.floor(score * F.lit(float(scale)))
    high = F.rint(score * F.lit(float(2**24))) / F.lit(float(2**24))
    gap = (high * F.lit(2.0 * scale) - (2 * low + 1)) + (score - high) * F.lit(2.0 * scale)
    up = (gap > 0) | ((gap == 0) & (low % 2 == 1))
    units = low + up.cast("long")
    whole, rest = F.floor(units / scale), F.pmod(units, F.lit(scale))
    return F.concat(
        whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), decimals, "0")
    )


def prediction_violations(predictions: DataFrame) -> DataFrame:
    return checks.with_reason(
        predictions, [("score not finite in [0, 1]", ~in_unit(F.col("score")))]
    ).where(F.col("reason").isNotNull())


def prediction_rows(predictions: DataFrame) -> DataFrame:
    """(ord, filename, cm-score) with scores as six-decimal text."""
    return predictions.select("ord", "filename", score_text(F.col("score")).alias("cm-score"))


def require_fresh(inputs: DataFrame, target: str) -> None:
    """Refuse a target that is one of the inputs or holds one."""
    inside = F.col("path").startswith(target.rstrip("/") + "/") | (F.col("path") == target)
    checks.fail_if_any(inputs.where(inside).select("path"), "output would overwrite an input")


def write_predictions(predictions: DataFrame, path: str, single_file: bool = False) -> None:
    """Ordered TSV.  Rows are range-partitioned on ``ord``, so the part files read in name order
    give the template's order without passing all rows through one task.  ``single_file`` is for
    the small challenge hand-in format."""
    checks.fail_if_any(prediction_violations(predictions), "predictions")
    rows = prediction_rows(predictions)
    rows = rows.coalesce(1).sortWithinPartitions("ord") if single_file else rows.orderBy("ord")
    rows.drop("ord").write.csv(path, sep="\t", header=True, mode="errorifexists")


def write_json(rows: DataFrame, path: str) -> None:
    """Explanations (one object per clip) or a one-row report."""
    rows.write.json(path, mode="errorifexists")


def split_rows(split: DataFrame) -> DataFrame:
    """Split manifest rows with canonical label text; ``side`` says train or test."""
    group = [F.col("grp").alias("group")] if "grp" in split.columns else []
    return split.select("side", "filename", label_text(F.col("label")).alias("label"), *group)


def write_splits(split: DataFrame, path: str, source: str) -> None:
    """One directory per side under ``path``; refuses to replace the source manifest."""
    if source.rstrip("/") in (path.rstrip("/"), f"{path.rstrip('/')}/train", f"{path.rstrip('/')}/test"):
        raise ValueError("split output would overwrite the source manifest")
    rows = split_rows(split)
    for side in ("train", "test"):
        part = rows.where(F.col("side") == side).drop("side")
        part.write.csv(f"{path}/{side}", header=True, mode="errorifexists")


def write_oof(scores: DataFrame, path: str) -> None:
    """Out-of-fold scores, rounded, one directory per partition."""
    scores.withColumn("score", F.round("score", OOF_DECIMALS)).write.partitionBy("partition").parquet(
        path, mode="errorifexists"
    )
