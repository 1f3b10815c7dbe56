"""The train command: manifests, leakage guards, split, features, two forests, holdout report."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipscore.functions import vectors as V
from clipscore.functions.containers import with_verdict
from clipscore.functions.scores import REAL_WEIGHT, container_adjusted, suffix
from clipscore.operators import clip_features as CF
from clipscore.operators import joins, splits
from clipscore.operators import metrics as M
from clipscore.operators import models as Mo
from clipscore.sources import checks, manifest, sinks, store

SPECTRAL = tuple(i for i, n in enumerate(V.BASE) if not n.startswith(("mfcc_", "chroma_")))


def contents(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """Bytes of the wanted paths, whatever their number: the folder's files that are wanted.

    Files outside the wanted span of modification times are not opened: the scan gets it as a filter.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    span = wanted.agg(F.min("modificationTime"), F.max("modificationTime")).first()
    if span[0] is None:
        return files.where(F.lit(False))
    dated = files.where(F.col("modificationTime").between(*span))
    return dated.join(wanted.select("path").distinct(), "path", "left_semi")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root``; ``filename`` is the path relative to it, as manifests name clips."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(bare(root)) + "/", "")
    return files.select("path", "length", "modificationTime", below.alias("filename"))


def bare(root: str) -> str:
    """A folder without its scheme and trailing slash."""
    return re.sub("^[a-z]+:/*", "/", root).rstrip("/")


def extract_base(spark: SparkSession, root: str, mode: str):
    """Extractor for the store: missing clips to (identity, vector, reason); ``mode="fail"`` stops at a bad clip."""

    def run(todo: DataFrame) -> DataFrame:
        files = contents(spark, root, todo).select("path", "content")
        rows = files.join(todo.select("path", "identity"), "path")
        clips = rows.withColumn("clip_id", F.col("identity"))
        made, _ = CF.features(clips, ("base",), mode=mode, together=mode != "fail")
        reason = "reason" if mode != "fail" else F.lit(None).cast("string").alias("reason")
        return made.select(F.col("clip_id").alias("identity"), F.col("base").alias("vector"), reason)

    return run


def holdout_report(scored: DataFrame, everything: DataFrame, method: str = "group holdout") -> DataFrame:
    """One-row report: sample counts and container-adjusted metrics of the holdout.

    ``scored`` needs label, score and status; every aggregate is one row, joined as scalars.  Scores are kept, as
    several aggregates read them.
    """
    scored = scored.select("label", "score", "status").persist()
    adjusted = scored.withColumn("score", container_adjusted(F.col("score"), F.col("status")))
    facts = everything.agg(
        F.count("*").alias("samples"),
        F.count_if(F.col("label") == 0).alias("real"),
        F.count_if(F.col("label") == 1).alias("synthetic"),
    )
    curve = M.score_curve(adjusted, [])
    conf = M.confusion(adjusted, [])
    counts = scored.agg(
        F.struct(
            F.count("*").alias("test_samples"),
            F.count_if(F.col("status") == "consistent").alias("consistent"),
            F.count_if(F.col("status") == "inconsistent").alias("inconsistent"),
        ).alias("c")
    )

    def rounded(df: DataFrame, column: str):
        return df.select(F.round(column, 4)).scalar()

    return facts.select(
        "*",
        F.lit(method).alias("method"),
        rounded(M.auc(curve, []), "auc").alias("roc_auc"),
        rounded(M.average_precision(curve, []), "ap").alias("average_precision"),
        rounded(conf, "accuracy").alias("accuracy_at_half"),
        rounded(conf, "balanced_accuracy").alias("balanced_accuracy_at_half"),
        counts.scalar().alias("holdout"),
        F.lit(REAL_WEIGHT).alias("metadata_real_weight"),
    )


def with_status(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Container status of the given clips (holdout only; nothing is decoded)."""
    files = contents(spark, root, rows).select("path", "length", "content")
    checked = with_verdict(files.withColumn("suffix", suffix(F.col("path"))))
    return rows.join(checked.select("path", F.col("container.status").alias("status")), "path")


def train(
    spark: SparkSession,
    manifest_path: str,
    root: str,
    output: str,
    test_manifest: str | None = None,
    feature_store: str | None = None,
    test_size: float = 0.2,
    seed: int = 42,
    trees: int = 300,
    depth: int = 12,
    mode: str = "fail",
) -> DataFrame:
    """Fit on the training side only, report on a disjoint holdout, save the model and the report."""
    files = listing(spark, root)
    rows, rejects = manifest.read_manifest(spark, manifest_path, files, mode)
    grouped = "grp" in rows.columns
    split, method = None, "group holdout" if grouped else "stratified clip holdout"
    if test_manifest is not None:
        test, more = manifest.read_manifest(spark, test_manifest, files, mode)
        rejects = rejects.unionByName(more)
        if ("grp" in test.columns) != grouped:
            raise ValueError("both manifests need groups, or neither")
        shared = joins.leakage(rows, test, "filename", "grp" if grouped else "filename")
        checks.fail_if_any(shared, "training and test manifests overlap")
        split = rows.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
        method = "provided test manifest"
    else:
        split = splits.split_data(rows, "label", "filename", "grp" if grouped else None, test_size, seed)
    everything = rows.withColumn("side", F.lit("train")) if split is None else split
    everything = everything.join(files, "filename").withColumn("clip_id", F.col("filename")).persist()

    # The store keeps what was extracted: a failed or repeated run starts from there.
    place = feature_store or Mo.shared_path(spark)
    stored = store.extend_store(
        spark, place, everything.select("path", "length", "modificationTime"), CF.CODE_VERSION, "base",
        extract_base(spark, root, mode),
    )
    if mode == "fail":
        checks.fail_if_any(stored.where("reason IS NOT NULL").select("path", "reason"), "stored clips")
    else:
        unusable = stored.where("reason IS NOT NULL").select(F.col("path").alias("item"), "reason")
        sinks.write_json(rejects.unionByName(unusable, allowMissingColumns=True), f"{output}/rejects")
    usable = stored.where("reason IS NULL")
    data = everything.join(usable.select("path", F.col("vector").cast("array<double>").alias("v")), "path")
    data = data.persist()
    model = Mo.fit_blend(data.where("side = 'train'"), Mo.two_forests(SPECTRAL, "v", trees, depth))
    model.save(f"{output}/model")
    if split is None:
        report = data.agg(F.count("*").alias("samples")).withColumn(
            "validation_note", F.lit("too few clips or groups for a two-class holdout")
        )
    else:
        held = with_status(spark, root, data.where("side = 'test'"))
        report = holdout_report(model.score(held), data, method)
    top = Mo.importance(model, V.BASE).orderBy(F.desc("importance"), "feature")
    sinks.write_json(top.coalesce(1), f"{output}/importance")
    sinks.write_json(report, f"{output}/report")
    return spark.read.json(f"{output}/report")
