"""Stand-in clip tables derived from the shared test tables (V1-V4), and their SQL twins.

The test tables hold no audio or scores; these views give them the shapes of a scored manifest,
ordered frame series, magnitude spectra and a container listing.  ``clips`` renders every
document as a PCM WAV file so the byte-level jobs have input that grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipscore.operators.ordered import ranked


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """V1: labelled manifest with two scores and a container status."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    i = F.col("doc_id")
    spoof = 1 - F.col("quality")
    mod10 = (i * 31) % 10
    return labels.join(docs, "doc_id").select(
        i.alias("clip_id"),
        spoof.cast("int").alias("label"),
        F.when(F.col("quality") == 1, F.concat(F.lit("real:"), "source"))
        .otherwise(F.concat(F.lit("synthetic:"), "lang"))
        .alias("grp"),
        F.when(mod10 < 6, "consistent")
        .when(mod10 < 9, "inconsistent")
        .otherwise("unknown")
        .alias("status"),
        (F.lit(0.7) * (((i * 7919) % 97) / F.lit(96.0)) + F.lit(0.3) * spoof).alias("primary_score"),
        (F.lit(0.8) * (((i * 104729) % 89) / F.lit(88.0)) + F.lit(0.2) * spoof).alias(
            "secondary_score"
        ),
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """V2: one ordered series per clip (clip_id, frame_idx, n_frames, x)."""
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("clip_id"), "ts", "event_id", "value"
    )
    return ranked(events, ["clip_id"], ["ts", "event_id"], "rn", "n_frames").select(
        "clip_id",
        (F.col("rn") - 1).cast("int").alias("frame_idx"),
        "n_frames",
        ((F.col("value") - 50.0) / 500.0).alias("x"),
    )


def spectra(spark: SparkSession, sf: str) -> DataFrame:
    """V3: one 64-bin magnitude spectrum per row; bin i stands for i*8000/63 Hz."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("clip_id"),
        (F.col("label") % 2).cast("int").alias("label"),
        F.col("label").alias("cluster"),
        F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("mag"),
    )


def containers(spark: SparkSession, sf: str) -> DataFrame:
    """V4: listing with suffix and leading text."""
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("clip_id"),
        F.col("url").alias("path"),
        F.lower(F.regexp_extract("url", r"[.]([A-Za-z0-9]+)([?#]|$)", 1)).alias("suffix"),
        F.substring("html", 1, 15).alias("head"),
        F.length("html").alias("size"),
    )


SCORED = """scored AS (
SELECT l.doc_id AS clip_id, CAST(1 - l.quality AS INT) AS label,
       CASE WHEN l.quality = 1 THEN concat('real:', d.source)
            ELSE concat('synthetic:', d.lang) END AS grp,
       CASE WHEN (l.doc_id*31) % 10 < 6 THEN 'consistent'
            WHEN (l.doc_id*31) % 10 < 9 THEN 'inconsistent' ELSE 'unknown' END AS status,
       7e-1*(((l.doc_id*7919) % 97)/96e0) + 3e-1*(1-l.quality) AS primary_score,
       8e-1*(((l.doc_id*104729) % 89)/88e0) + 2e-1*(1-l.quality) AS secondary_score
FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

FRAMES = """frames AS (
SELECT user_id AS clip_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame_idx,
       count(*) OVER (PARTITION BY user_id) AS n_frames, (value - 50e0) / 500e0 AS x
FROM events)"""

SPECTRA = """spectra AS (
SELECT vec_id AS clip_id, CAST(label % 2 AS INT) AS label, label AS cluster,
       list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE))) AS mag
FROM embeddings)"""

CONTAINERS = """containers AS (
SELECT page_id AS clip_id, url AS path,
       lower(regexp_extract(url, '[.]([A-Za-z0-9]+)([?#]|$)', 1)) AS suffix,
       substring(html, 1, 15) AS head, length(html) AS size
FROM pages)"""


CLIP_RATE = 4_000


def _le(value, n: int):
    """Little-endian bytes of an unsigned integer column, as hex text."""
    text = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(n))])


def clips(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as the bytes of an 8-bit mono PCM WAV file: its whole text is the samples."""
    # One file is one partition here; rendering and decoding are dealt to all cores.
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    docs = docs.repartition(spark.sparkContext.defaultParallelism)
    body = F.encode("text", "UTF-8")
    n = F.octet_length(body)
    pad = n % 2

    def fixed(v: int, width: int):
        return _le(F.lit(v), width)

    header = F.concat(
        F.lit("52494646"), _le(n + pad + 36, 4), F.lit("57415645666D7420"), fixed(16, 4), fixed(1, 2),
        fixed(1, 2), fixed(CLIP_RATE, 4), fixed(CLIP_RATE, 4), fixed(1, 2), fixed(8, 2),
        F.lit("64617461"), _le(n, 4),
    )
    tail = F.when(pad == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    return docs.select(
        F.col("doc_id").alias("clip_id"),
        F.concat("lang", F.lit("/clip"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"),
        n.cast("long").alias("n_bytes"),
        F.concat(F.unhex(header), body, tail).alias("content"),
    ).withColumn("length", F.octet_length("content").cast("long"))
