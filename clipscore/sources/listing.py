"""File listings: audio scan, name rules, archive-member rules and the tag table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipscore.functions.scores import basename, suffix
from clipscore.sources import checks

# Audio suffixes, archive rules, encoder terms.
AUDIO_SUFFIXES = (
    ".wav", ".mp3", ".m4a", ".mp4", ".ogg", ".flac", ".aac", ".wma", ".aif", ".aiff", ".webm", ".opus",
)
SAFE_PART = r"^[A-Za-z0-9_.-]+$"
REAL_MEMBER = r"^LJ\d{3}-\d{4}\.wav$"
ENCODER_TERMS = (
    "elevenlabs", "eleven labs", "tts", "text to speech", "synthesized", "synthetic",
    "amazon polly", "google", "openai", "qwen",
)


def scan_audio(spark: SparkSession, path: str) -> DataFrame:
    """Audio files under ``path`` without reading their bytes (path, length, modificationTime)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "modificationTime")
    )
    return (
        files.where(suffix(F.col("path")).isin(*AUDIO_SUFFIXES))
        .withColumn("filename", basename(F.col("path")))
        .withColumn("suffix", suffix(F.col("path")))
    )


def require_listing(listing: DataFrame) -> DataFrame:
    """Fail on an empty listing or on basenames that would make the filename ambiguous."""
    if listing.isEmpty():
        raise ValueError("no supported audio files found")
    checks.fail_if_any(checks.repeated(listing, "filename", "duplicate basename"), "audio listing")
    return listing


def duplicate_names(listing: DataFrame, path: str = "path") -> DataFrame:
    """Basenames that occur more than once, with their count."""
    return listing.groupBy(basename(F.col(path)).alias("filename")).count().where("count > 1")


def path_parts(member: Column) -> Column:
    """Path components; repeated slashes and single dots vanish, a leading slash stays unsafe."""
    parts = F.filter(F.split(member, "/"), lambda p: (p != "") & (p != "."))
    return F.when(member.startswith("/"), F.concat(F.array(F.lit("/")), parts)).otherwise(parts)


def safe(parts: Column) -> Column:
    return (F.size(parts) > 0) & F.forall(
        parts, lambda p: p.rlike(SAFE_PART) & ~p.isin(".", "..")
    )


def check_members(
    listing: DataFrame,
    depth: tuple[int, ...],
    name_pattern: str,
    member: str = "member",
    size: str = "size",
    max_bytes: int | None = None,
) -> DataFrame:
    """Archive listing with ``status``: accepted, ignored (other file), or why it is refused.

    A member that occurs twice is refused; sizes are limited only if the caller sets a limit.
    """
    parts = path_parts(F.col(member))
    name = F.element_at(parts, -1)
    fits = F.size(parts).isin(*depth) & name.rlike(name_pattern)
    twice = listing.groupBy(F.col(member).alias("_member")).count().where("count > 1").select("_member", F.lit(True).alias("_twice"))
    status = (
        F.when(~safe(parts), "unsafe path")
        .when(~fits, "ignored")
        .when(F.lit(False) if max_bytes is None else F.col(size) > max_bytes, "too large")
        .when(F.col("_twice"), "duplicate member")
        .otherwise("accepted")
    )
    marked = listing.join(twice, F.col(member) == F.col("_member"), "left")
    return marked.withColumn("status", status).drop("_member", "_twice")


def tag_flags(clips: DataFrame, tags: DataFrame) -> DataFrame:
    """Per clip: any tag at all, and any encoder term in the lower-cased "key value" text."""
    text = F.lower(F.concat_ws(" ", "key", "value"))
    named = F.lit(False)
    for term in ENCODER_TERMS:
        named = named | text.contains(term)
    seen = tags.groupBy("clip_id").agg(
        F.lit(1.0).alias("has_metadata"), F.bool_or(named).cast("double").alias("has_encoder_tag")
    )
    return clips.join(seen, "clip_id", "left").na.fill(0.0, ["has_metadata", "has_encoder_tag"])
