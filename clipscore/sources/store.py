"""Feature store: per-clip identity, extract-only-what-is-missing, spot checks, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipscore.operators.ordered import ranked
from clipscore.operators.sampling import spaced_positions
from clipscore.sources import checks


def identity(code_version: str, view: str) -> Column:
    """Per-clip fingerprint of (view, extractor version, path, size, modification time)."""
    parts = ("path", "length", "modificationTime")
    return F.sha2(F.concat_ws("|", F.lit(view), F.lit(code_version), *[F.col(p).cast("string") for p in parts]), 256)


def missing_clips(listing: DataFrame, store: DataFrame, code_version: str, view: str) -> DataFrame:
    """Clips whose current identity is not in the store yet: new, changed, or from older code."""
    wanted = listing.withColumn("identity", identity(code_version, view))
    return wanted.join(store.select("identity"), "identity", "left_anti")


def extend_store(
    spark: SparkSession, path: str, listing: DataFrame, code_version: str, view: str, extract
) -> DataFrame:
    """Append missing clips and return the rows of the current listing: a ``vector``, or the ``reason`` for none.

    ``extract`` maps a listing to (identity, vector) and, where clips can be rejected, reason.  Rejected clips are
    stored like others, so they are not read again before they change.  An interrupted run resumes by
    itself: what was committed is found by identity, within the part of this code version alone.
    """
    target = f"{path}/view={view}/code={code_version}"
    try:
        store = spark.read.parquet(target)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        store = None
    wanted = listing.withColumn("identity", identity(code_version, view))
    todo = wanted if store is None else missing_clips(listing, store, code_version, view)
    made = extract(todo)
    reason = F.col("reason") if "reason" in made.columns else F.lit(None).cast("string")
    made.select("identity", F.when(reason.isNull(), F.col("vector")).alias("vector"), reason.alias("reason")).write.mode("append").parquet(target)
    saved = spark.read.parquet(target).dropDuplicates(["identity"])
    return wanted.join(saved, "identity")


def compacted(spark: SparkSession, path: str, code_version: str, view: str, output: str) -> DataFrame:
    """Write a store's part as one row per identity to ``output``, a new store; appends of many runs leave small files
    and, where runs met, repeated rows."""
    rows = spark.read.parquet(f"{path}/view={view}/code={code_version}").dropDuplicates(["identity"])
    rows.write.mode("errorifexists").parquet(f"{output}/view={view}/code={code_version}")
    return spark.read.parquet(f"{output}/view={view}/code={code_version}")


def spot_check(
    store: DataFrame,
    listing: DataFrame,
    written_at: Column,
    recompute,
    rows: int = 5,
) -> list[int]:
    """Trust an old store (columns ``pos``, ``path``, ``vector``) only if no source is newer and
    ``rows`` evenly spaced rows recompute to exactly the same vector.  Returns checked positions."""
    newer = listing.where(F.col("modificationTime") > written_at)
    checks.fail_if_any(newer.select("path"), "audio changed after the store was written")
    n = store.count()
    positions = spaced_positions(n, min(rows, n))
    picked = store.where(F.col("pos").isin(positions))
    fresh = recompute(picked.select("pos", "path")).withColumnRenamed("vector", "fresh")
    differ = picked.join(fresh, "pos", "left").where(
        F.col("fresh").isNull() | ~F.col("vector").eqNullSafe(F.col("fresh"))
    )
    checks.fail_if_any(differ.select("pos"), "stored features differ from the audio")
    return positions


def number_rows(store: DataFrame, order: str = "path") -> DataFrame:
    """Zero-based ``pos`` by path order."""
    return ranked(store, [], [order], "pos").withColumn("pos", F.col("pos") - 1)


def checksum(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of each file under ``path``, as recorded in reports and policies."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def require_bundle(bundle: dict, version: int, kind: str, feature_names: tuple[str, ...]) -> None:
    """Refuse a saved model or policy made for other features, or with weights outside [0, 1]."""
    if bundle.get("version") != version or bundle.get("kind") != kind:
        raise ValueError(f"bundle is not {kind} version {version}")
    if tuple(bundle.get("feature_names", ())) != tuple(feature_names):
        raise ValueError("bundle was trained on other features")
    for name in ("metadata_real_weight", "temporal_weight"):
        if not 0 <= float(bundle.get(name, 0.0)) <= 1:
            raise ValueError(f"{name} must lie in [0, 1]")
