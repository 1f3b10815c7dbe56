"""Labelled manifests, score tables, templates and protocols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipscore.functions.scores import in_unit, label_of
from clipscore.operators.ordered import running
from clipscore.sources import checks

# Protocol layout.
PROTOCOL_FIELDS = (
    "speaker", "utterance", "gender", "codec", "quality", "seed", "condition", "attack", "key", "tmp",
)
UTTERANCE_ID = r"^[TDE]_[0-9]{10}$"


def delimiter(path: str) -> str:
    return "\t" if path.lower().endswith(".tsv") else ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Text columns with a header row; Spark strips a UTF-8 byte-order mark itself."""
    return spark.read.csv(path, header=True, sep=sep or delimiter(path), encoding="UTF-8")


def require_columns(df: DataFrame, names: set[str], what: str) -> None:
    missing = sorted(names - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")


def normalized(raw: DataFrame) -> DataFrame:
    """Trim names and groups and map the label text; unusable labels become null."""
    require_columns(raw, {"filename", "label"}, "manifest")
    group = [F.trim("group").alias("grp")] if "group" in raw.columns else []
    rest = [c for c in raw.columns if c not in ("filename", "label", "group")]
    return raw.select(
        F.trim("filename").alias("filename"), label_of(F.col("label")).alias("label"), *group, *rest
    )


def row_violations(manifest: DataFrame) -> DataFrame:
    """Add ``reason`` for blank names, unknown labels and blank groups."""
    blank = F.coalesce(F.col("filename") == "", F.lit(True))
    rules = [("invalid filename or label", blank | F.col("label").isNull())]
    if "grp" in manifest.columns:
        rules.append(("missing group", F.col("grp").isNull() | (F.col("grp") == "")))
    return checks.with_reason(manifest, rules)


def manifest_violations(manifest: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Every problem of a manifest as (item, reason): bad rows, missing files, duplicates, and a
    class that is absent altogether.  Problems of one row name its file and line where they are known."""
    bad = row_violations(manifest).where(F.col("reason").isNotNull())
    lines = [c for c in ("source_file", "line") if c in manifest.columns]
    parts = [
        bad.select(F.col("filename").alias("item"), "reason", *lines),
        checks.repeated(manifest, "filename", "duplicate path"),
        manifest.agg(F.count_distinct("label").alias("n"))
        .where("n <> 2")
        .select(F.lit("label").alias("item"), F.lit("needs both classes").alias("reason")),
    ]
    if listing is not None:
        absent = manifest.join(listing.select("filename"), "filename", "left_anti")
        parts.append(
            absent.select(F.col("filename").alias("item"), F.lit("missing audio").alias("reason"), *lines)
        )
    return checks.union(parts)


def with_lines(df: DataFrame, name: str = "line", first: int = 2) -> DataFrame:
    """Number the rows of every file that ``df`` reads, in file order (data below a header starts on line 2);
    adds ``source_file`` too.

    A large file is read in blocks.  Rows are counted per block, running sums of the counts give where a
    block starts, and a window inside each block does the rest: no task sees more than a block.
    """
    meta = F.col("_metadata")
    at = df.select("*", meta["file_path"].alias("source_file"), meta["file_block_start"].alias("_block")).withColumn("_at", F.monotonically_increasing_id())
    counts = at.groupBy("source_file", "_block").agg(F.count("*").alias("_rows"))
    starts = running(counts, ["source_file"], ["_block"], {"_start": F.col("_rows")}).select("source_file", "_block", "_start_before")
    inside = Window.partitionBy("source_file", "_block").orderBy("_at")
    placed = at.withColumn("_n", F.row_number().over(inside)).join(starts, ["source_file", "_block"])
    line = (F.col("_start_before") + F.col("_n") + (first - 1)).cast("bigint")
    return placed.select(*df.columns, "source_file", line.alias(name))


def read_manifest(
    spark: SparkSession, path: str, listing: DataFrame | None = None, mode: str = "fail"
) -> tuple[DataFrame, DataFrame]:
    """Manifest as (filename, label[, grp]) plus its rejects, which carry source_file and line."""
    numbered = normalized(with_lines(read_delimited(spark, path).drop("line", "source_file")))
    problems = manifest_violations(numbered, listing)
    rows = normalized(read_delimited(spark, path))
    if mode == "fail":
        checks.fail_if_any(problems, f"manifest {path}")
        return rows, problems
    good, _ = checks.admit(row_violations(rows), mode, path)
    if listing is not None:
        good = good.join(listing.select("filename"), "filename", "left_semi")
    return good.dropDuplicates(["filename"]), problems


def score_column(columns: list[str], preferred: str) -> str:
    """First present of the preferred name and the two common ones."""
    for name in (preferred, "cm-score", "score"):
        if name in columns:
            return name
    raise ValueError(f"score table needs one of {preferred}, cm-score, score")


def parse_scores(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Trim the name (and group) and parse score texts; ``columns`` maps output to input name."""
    numbers = [F.expr(f"try_cast(trim(`{src}`) AS double)").alias(out) for out, src in columns.items()]
    keep = [c for c in ("label", "grp") if c in raw.columns]
    return raw.select(F.trim("filename").alias("filename"), *keep, *numbers)


def score_violations(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``reason``: blank name, or a score that is not a finite number in [0, 1]."""
    rules = [("blank filename", F.col("filename") == "")]
    rules += [(f"bad {c}", ~in_unit(F.col(c))) for c in columns]
    return checks.with_reason(scores, rules)


def read_scores(
    spark: SparkSession, path: str, preferred: str, mode: str = "fail"
) -> tuple[DataFrame, DataFrame]:
    """External score table as (filename, score) plus rejects."""
    raw = read_delimited(spark, path)
    require_columns(raw, {"filename"}, "score table")
    parsed = parse_scores(raw, {"score": score_column(raw.columns, preferred)})
    if mode == "fail":
        if parsed.isEmpty():
            raise ValueError(f"score table {path} holds no scores")
        checks.fail_if_any(
            checks.repeated(parsed, "filename", "duplicate filename"), f"score table {path}"
        )
    return checks.admit(score_violations(parsed, ["score"]), mode, f"score table {path}")


def read_score_pairs(
    spark: SparkSession,
    path: str,
    primary: str,
    secondary: str,
    listing: DataFrame | None = None,
    mode: str = "fail",
) -> tuple[DataFrame, DataFrame]:
    """Two-score table as (filename, label, grp, primary, secondary) plus rejects."""
    raw = read_delimited(spark, path)
    require_columns(raw, {"filename", "label", "group", primary, secondary}, "score table")
    text = raw.select("filename", label_of(F.col("label")).alias("label"), F.trim("group").alias("grp"),
                      primary, secondary)
    pairs = parse_scores(text, {"primary": primary, "secondary": secondary})
    problems = manifest_violations(pairs, listing).where("reason <> 'needs both classes'")
    if mode == "fail":
        if pairs.isEmpty():
            raise ValueError(f"score table {path} holds no rows")
        checks.fail_if_any(problems, f"score table {path}")
    return checks.admit(score_violations(pairs, ["primary", "secondary"]), mode, path)


def name_mismatches(left: DataFrame, right: DataFrame, key: str = "filename") -> DataFrame:
    """Names that are not in both tables exactly once, as (item, reason).  One shuffle per side,
    counts merged before it, so repeated names stay cheap."""
    counts = checks.union(
        [
            left.select(F.col(key).cast("string").alias("item"), F.lit(1).alias("l"), F.lit(0).alias("r")),
            right.select(F.col(key).cast("string").alias("item"), F.lit(0).alias("l"), F.lit(1).alias("r")),
        ]
    )
    reason = (
        F.when(F.col("l") == 0, "only right")
        .when(F.col("r") == 0, "only left")
        .otherwise("duplicate")
    )
    totals = counts.groupBy("item").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return totals.where("l <> 1 OR r <> 1").select("item", reason.alias("reason"))


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """Template names with their row order ``ord`` (tab-separated whatever the suffix)."""
    raw = read_delimited(spark, path, "\t")
    require_columns(raw, {"filename"}, "template")
    return with_lines(raw, "ord", 1).select(F.trim("filename").alias("filename"), "ord")


def ordered_by_template(inputs: DataFrame, template: DataFrame) -> DataFrame:
    """Inputs with the template's ``ord``; the two name sets must match exactly once each."""
    checks.fail_if_any(name_mismatches(template, inputs), "template and inputs differ")
    return inputs.join(template.select("filename", "ord"), "filename")


def parse_protocol(lines: DataFrame, column: str = "value") -> DataFrame:
    """Whitespace-separated protocol lines as named fields plus ``reason``; blank lines dropped."""
    fields = F.split(F.trim(F.regexp_replace(column, r"^\x{FEFF}", "")), r"\s+")
    split = lines.where(F.trim(column) != "").withColumn("_f", fields)
    named = split.select(
        *[c for c in lines.columns if c != column],
        F.size("_f").alias("n_fields"),
        *[F.get("_f", i).alias(name) for i, name in enumerate(PROTOCOL_FIELDS)],
    )
    return checks.with_reason(
        named,
        [
            ("needs 10 fields", F.col("n_fields") != len(PROTOCOL_FIELDS)),
            ("unsafe utterance id", ~F.col("utterance").rlike(UTTERANCE_ID)),
            ("unrecognized key", ~F.col("key").isin("bonafide", "spoof")),
        ],
    ).drop("n_fields")


def protocol_manifest(protocol: DataFrame, listing: DataFrame, prefix: str) -> DataFrame:
    """Clips of a parsed protocol whose audio is listed: real clips group by speaker, synthetic
    clips by attack."""
    rows = protocol.where(F.col("reason").isNull())
    rows = rows.withColumn("filename", F.concat("utterance", F.lit(".flac")))
    real = F.col("key") == "bonafide"
    return rows.join(listing.select("filename"), "filename").select(
        "filename",
        F.when(real, 0).otherwise(1).alias("label"),
        F.when(real, F.concat(F.lit(f"{prefix}:real:"), "speaker"))
        .otherwise(F.concat(F.lit(f"{prefix}:spoof:"), "attack"))
        .alias("grp"),
    )


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """Counts by class, distinct groups and the sorted attack families, in one row."""
    by_group = manifest.groupBy("label", "grp").agg(F.count("*").alias("n"))
    family = F.when(F.col("grp").contains(":spoof:"), F.substring_index("grp", ":", -1))
    return by_group.agg(
        F.sum("n").alias("clips"),
        F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("real"),
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)).alias("synthetic"),
        F.count_distinct("grp").alias("groups"),
        F.array_join(F.array_sort(F.collect_set(family)), ",").alias("families"),
    )


def build_protocol_manifest(
    spark: SparkSession, path: str, listing: DataFrame, prefix: str, mode: str = "fail"
) -> tuple[DataFrame, DataFrame]:
    parsed = parse_protocol(with_lines(spark.read.text(path), first=1))
    good, rejects = checks.admit(parsed, mode, f"protocol {path}")
    manifest = protocol_manifest(good.withColumn("reason", F.lit(None)), listing, prefix)
    if mode == "fail":
        checks.fail_if_any(
            checks.repeated(manifest, "filename", "duplicate audio reference"), f"protocol {path}"
        )
        if manifest.agg(F.count_distinct("label")).first()[0] != 2:
            raise ValueError("protocol and audio must hold both real and synthetic clips")
    return manifest, rejects

