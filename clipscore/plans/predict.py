"""Batch scoring of a clip folder: base, LFCC, fused and routed variants."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipscore.functions import vectors as V
from clipscore.functions.containers import with_verdict
from clipscore.functions.scores import (
    basename,
    check_weight,
    container_adjusted,
    fallback_score,
    mix,
    suffix,
)
from clipscore.operators import clip_features as CF
from clipscore.operators import models as Mo
from clipscore.operators.ordered import ranked
from clipscore.operators.routing import Router, routed
from clipscore.operators.sampling import top_contributions
from clipscore.sources import checks, manifest, sinks
from clipscore.sources.listing import AUDIO_SUFFIXES, require_listing, scan_audio


def inputs(spark: SparkSession, path: str, template: str | None) -> DataFrame:
    """Listed clips with ``ord``: the template's row order, else case-blind path order."""
    files = require_listing(scan_audio(spark, path))
    if template is not None:
        return manifest.ordered_by_template(files, manifest.read_template(spark, template))
    low = files.withColumn("_low", F.lower("path"))
    return ranked(low, [], ["_low", "path"], "ord").drop("_low")


def clip_rows(spark: SparkSession, path: str, listed: DataFrame, views: tuple[str, ...], lowpass_hz=None, mode="fail"):
    """Features and container status of the listed clips, plus rejects (clip_id, reason).

    The bytes are read once and joined to nothing: the container's verdict is a column that rides
    along, and the listing's names and order are joined to the finished rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    clips = with_verdict(files.where(suffix(F.col("path")).isin(*AUDIO_SUFFIXES)).select(
        "path", "length", "content", suffix(F.col("path")).alias("suffix"), basename(F.col("path")).alias("clip_id"),
    ))
    good, rejects = CF.features(clips, views, lowpass_hz=lowpass_hz, mode=mode, keep=("path", "container"))
    rows = good.join(listed.select("path", "filename", "ord"), "path")
    return rows, rejects.join(listed.select("path"), "path", "left_semi").drop("path", "container")


def finish(
    rows: DataFrame, score: Column, listed: DataFrame, output: str, rejects: DataFrame | None = None, template: str | None = None
) -> DataFrame:
    """Validate and write (ord, filename, score); the output may not cover an input.

    Rejected clips are written beside the predictions, with their reasons.  A template wants every
    name scored: then a rejected clip is an error.
    """
    sinks.require_fresh(listed, output)
    predictions = rows.select("ord", "filename", score.alias("score"))
    if template is not None:
        unscored = listed.select("filename").join(predictions.select("filename"), "filename", "left_anti")
        checks.fail_if_any(unscored, "template names without a score")
    if rejects is not None:
        sinks.write_json(rejects, f"{output.rstrip('/')}_rejects")
    sinks.write_predictions(predictions, output)
    return predictions


def kept(rejects: DataFrame, mode: str) -> DataFrame | None:
    """The rejects to write; in fail mode there are none."""
    return None if mode == "fail" else rejects


def predict(
    spark: SparkSession, model: Mo.Blend, path: str, output: str, template: str | None = None,
    explanations: str | None = None, mode: str = "fail",
) -> DataFrame:
    """Base model with the container prior; explanations are one JSON object per clip."""
    listed = inputs(spark, path, template)
    rows, bad = clip_rows(spark, path, listed, ("base",), mode=mode)
    rows = rows.withColumn("v", F.col("base").cast("array<double>"))
    scored = model.score(rows, "audio_score")
    final = container_adjusted(F.col("audio_score"), F.col("container.status"))
    if explanations is None:
        return finish(scored, final, listed, output, kept(bad, mode), template)
    if explanations.rstrip("/") == output.rstrip("/"):
        raise ValueError("explanations would overwrite the predictions")
    sinks.require_fresh(listed, explanations)
    scored = scored.persist()  # explanations and predictions read it
    try:
        sinks.write_json(explained(scored, model, final), explanations)
        return finish(scored, final, listed, output, kept(bad, mode), template)
    finally:
        scored.unpersist()


def explained(scored: DataFrame, model: Mo.Blend, final: Column) -> DataFrame:
    """Evidence per clip: forest paths where the model is a forest, else component scores."""
    forests = all(m.spec.family in ("forest", "trees") for m, _ in model.parts)
    common = [
        "filename",
        final.alias("cm-score"),
        "audio_score",
        (final - F.col("audio_score")).alias("metadata_adjustment"),
        F.col("container").alias("metadata"),
    ]
    if not forests:
        parts = model.components(scored)
        components = F.array(
            *[
                F.struct(
                    F.lit(m.spec.name).alias("model"), F.lit(w).alias("weight"),
                    F.col(m.spec.name).alias("audio_score"),
                )
                for m, w in model.parts
            ]
        )
        return parts.select(*common, components.alias("component_scores"))
    paths = Mo.path_contributions(scored, model, len(V.BASE))
    names = F.array(*map(F.lit, V.BASE))
    evidence = F.transform(
        top_contributions(F.col("contributions"), names),
        lambda e: F.struct(
            e["feature"].alias("feature"),
            F.get("v", e["pos"]).alias("value"),
            e["contribution"].alias("contribution"),
            F.when(e["contribution"] > 0, "synthetic").otherwise("real").alias("direction"),
        ),
    )
    total = F.aggregate("contributions", F.lit(0.0), lambda s, v: s + v)
    return paths.select(
        *common,
        F.col("baseline").alias("baseline_probability"),
        total.alias("total_contribution"),
        evidence.alias("feature_evidence"),
    )


def predict_lfcc(
    spark: SparkSession, model: Mo.Fitted | Mo.Blend, path: str, output: str, template: str | None = None,
    lowpass_hz: float | None = None, real_weight: float = 0.0, mode: str = "fail",
) -> DataFrame:
    """Base plus LFCC model, optionally on the band-limited signal."""
    check_weight(real_weight, "metadata_real_weight")
    listed = inputs(spark, path, template)
    rows, bad = clip_rows(spark, path, listed, ("base", "lfcc"), lowpass_hz, mode)
    rows = rows.withColumn("v", F.concat("base", "lfcc").cast("array<double>"))
    scored = model.score(rows, "audio_score")
    final = container_adjusted(F.col("audio_score"), F.col("container.status"), real_weight)
    return finish(scored, final, listed, output, kept(bad, mode), template)


def read_policy(spark: SparkSession, path: str) -> tuple[float, float]:
    """(temporal weight, container weight) of a one-row JSON policy."""
    text = spark.read.text(path, wholetext=True).first()[0]
    policy = json.loads(text)
    names = ("temporal_weight", "metadata_real_weight")
    return tuple(check_weight(float(policy[n]), n) for n in names)


def predict_fused(
    spark: SparkSession, base: Mo.Blend, temporal: Mo.Fitted, policy: str, path: str, output: str,
    template: str | None = None, mode: str = "fail",
) -> DataFrame:
    """Container-adjusted base score mixed with the temporal score at the policy's weights."""
    weight, real_weight = read_policy(spark, policy)
    listed = inputs(spark, path, template)
    rows, bad = clip_rows(spark, path, listed, ("base", "temporal"), mode=mode)
    rows = rows.withColumn("v", F.col("base").cast("array<double>"))
    rows = base.score(rows, "_a").withColumn("temporal", F.col("temporal").cast("array<double>"))
    rows = temporal.score(rows, "_b")
    adjusted = container_adjusted(F.col("_a"), F.col("container.status"), real_weight)
    return finish(rows, mix(1.0 - weight, adjusted, F.col("_b")), listed, output, kept(bad, mode), template)


def predict_routed(
    spark: SparkSession, model: Mo.Blend, path: str, output: str, second: str | None = None,
    router: Router | None = None, template: str | None = None, mode: str = "fail",
) -> DataFrame:
    """First score alone without a second table, halves without a router, else routed by condition.
    The container prior is not applied on this path."""
    listed = inputs(spark, path, template)
    rows, bad = clip_rows(spark, path, listed, ("base", "quality"), mode=mode)
    rows = rows.withColumn("v", F.col("base").cast("array<double>"))
    scored = model.score(rows, "_a")
    if second is None:
        return finish(scored, F.col("_a"), listed, output, kept(bad, mode), template)
    table, _ = manifest.read_scores(spark, second, "second-score", mode)
    checks.fail_if_any(manifest.name_mismatches(table, listed), "second scores and inputs differ")
    both = scored.join(table.select("filename", F.col("score").alias("_b")), "filename")
    if router is None:
        return finish(both, fallback_score(F.col("_a"), F.col("_b"), F.lit(None).cast("double")), listed, output, kept(bad, mode), template)
    out = routed(both, router, "quality", "_a", "_b")
    return finish(out, F.col("routed"), listed, output, kept(bad, mode), template)


