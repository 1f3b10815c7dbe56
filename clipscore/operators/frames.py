"""Ordered frame series per clip: windows, deltas and aggregates over (clip_id, frame_idx, ...).

Windows run over chunks of consecutive frames with a halo of neighbours, so a clip of any length
is spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipscore.functions.vectors import WINDOWS
from clipscore.operators.ordered import chunked, own_rows


def neighbours(df: DataFrame, key: str, index: str, halo: int, columns: dict[str, object]) -> DataFrame:
    """Add columns built from a window over the ``halo`` rows around each frame.

    Each entry of ``columns`` is a function from the ordered window to a Column.
    """
    over = Window.partitionBy(key, "_chunk").orderBy(index)
    rows = chunked(df, index, halo)
    return own_rows(rows.select("*", *[make(over).alias(n) for n, make in columns.items()]))


def with_previous(df: DataFrame, column: str, key: str = "clip_id", index: str = "frame_idx") -> DataFrame:
    return neighbours(df, key, index, 1, {f"prev_{column}": lambda w: F.lag(column).over(w)})


def sign_change(x: Column, previous: Column) -> Column:
    """1.0 where the sign bit flips; magnitudes up to 1e-10 count as zero, zero as positive."""

    def negative(v: Column) -> Column:
        return v < -1e-10

    return F.when(previous.isNull(), 0.0).otherwise((negative(x) != negative(previous)).cast("double"))


def peak_normalized(df: DataFrame, column: str, name: str, key: str = "clip_id") -> DataFrame:
    """Divide by the clip's peak (null for a silent clip).  The peaks are one row per clip; a hot clip meets its single peak
    row in the join instead of being gathered by a window."""
    peaks = df.groupBy(key).agg(F.max(F.abs(column)).alias("_peak"))
    return df.join(peaks, key).withColumn(name, F.try_divide(F.col(column), F.col("_peak"))).drop("_peak")


def derivatives(df: DataFrame, column: str, n: str = "n_frames", key: str = "clip_id", index: str = "frame_idx") -> DataFrame:
    """Add ``delta`` and ``delta2``: derivatives of a 9-frame linear and quadratic fit.

    The fits over the outermost nine frames have constant derivatives, so the first and last four
    frames take the value found four frames in from the end.
    """

    def around(k: int):
        return lambda w: (F.lead(column, k) if k > 0 else F.lag(column, -k)).over(w)

    near = {f"_n{k}": around(k) for k in range(-8, 9) if k}
    rows = neighbours(df, key, index, 8, near)
    centre = F.greatest(F.lit(4), F.least(F.col(index), F.col(n) - 5))
    shift = (centre - F.col(index)).cast("int")
    window = F.slice(
        F.array(*[F.col(f"_n{k}") if k else F.col(column) for k in range(-8, 9)]), shift + 5, F.lit(9)
    )

    def fit(weights: list[float], scale: float) -> Column:
        terms = [F.get("_w", i) * F.lit(float(v)) for i, v in enumerate(weights)]
        return reduce(lambda a, b: a + b, terms) / scale

    steps = range(-4, 5)
    return (
        rows.withColumn("_w", window)
        .withColumn("delta", fit([k for k in steps], 60.0))
        .withColumn("delta2", fit([3 * k * k - 20 for k in steps], 462.0))
        .drop("_w", *near)
    )


def window_of(df: DataFrame, n: str = "n_frames", index: str = "frame_idx") -> DataFrame:
    """Add ``win``, the ordered window 0..7 of each frame, edges at floor(b * n / 8).

    With eight frames or more the windows are disjoint and the number is arithmetic; shorter clips
    repeat frames over windows.
    """
    i, total = F.col(index).cast("long"), F.col(n).cast("long")
    b = F.expr(f"({WINDOWS} * ({index} + 1) + {n} - 1) div {n} - 1")
    edge = lambda k: F.floor(k * total / WINDOWS)
    repeated = F.filter(
        F.sequence(F.lit(0).cast("long"), F.lit(WINDOWS - 1).cast("long")),
        lambda k: (edge(k) <= i) & (i < F.greatest(edge(k + 1), edge(k) + 1)),
    )
    return df.withColumn("win", F.explode(F.when(total >= WINDOWS, F.array(b)).otherwise(repeated)))


def window_stats(df: DataFrame, series: list[str], key: str = "clip_id") -> DataFrame:
    """Mean and population deviation of each series per (clip, window)."""
    return (
        window_of(df)
        .groupBy(key, "win")
        .agg(
            F.count("*").alias("frames"),
            *[f(s).alias(f"{s}_{k}") for s in series for k, f in (("mean", F.avg), ("std", F.stddev_pop))],
        )
    )


def trends(stats: DataFrame, series: list[str], key: str = "clip_id") -> DataFrame:
    """Slope of the window means against evenly spaced times from -1 to 1."""
    at = F.lit(-1.0) + F.lit(2.0) * F.col("win") / F.lit(WINDOWS - 1.0)
    return stats.groupBy(key).agg(
        *[F.regr_slope(F.col(f"{s}_mean"), at).alias(f"trend_{s}") for s in series]
    )


def mean_std_vector(df: DataFrame, series: list[str], key: str = "clip_id") -> DataFrame:
    """Clip vector (mean, population deviation) per series in order, as floats."""
    cols = [f(s).alias(f"{s}_{k}") for s in series for k, f in (("mean", F.avg), ("std", F.stddev_pop))]
    names = [f"{s}_{k}" for s in series for k in ("mean", "std")]
    return df.groupBy(key).agg(*cols).select(key, F.array(*names).cast("array<float>").alias("vector"))


def temporal_vector(df: DataFrame, series: list[str], key: str = "clip_id") -> DataFrame:
    """Window statistics in window order, then the trends, as one float vector per clip."""
    stats = window_stats(df, series, key)
    per_window = F.struct("win", F.array(*[f"{s}_{k}" for s in series for k in ("mean", "std")]).alias("v"))
    at = F.lit(-1.0) + F.lit(2.0) * F.col("win") / F.lit(WINDOWS - 1.0)
    # Eight rows per clip reach this aggregate.
    flat = stats.groupBy(key).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(per_window)), lambda e: e["v"])).alias("w"),
        F.array(*[F.regr_slope(F.col(f"{s}_mean"), at) for s in series]).alias("t"),
    )
    return flat.select(key, F.concat("w", "t").cast("array<float>").alias("vector"))


def admission(df: DataFrame, column: str, minimum: int, key: str = "clip_id") -> DataFrame:
    """Per clip: why its samples are not admitted (too short, not finite, silent), or null."""
    x = F.col(column)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.max(F.abs(x)).alias("peak"))
        .select(
            key,
            F.when(F.col("n") < minimum, "too short")
            .when((F.col("bad") > 0) | (F.col("peak") < 1e-6), "silence or non-finite samples")
            .alias("reason"),
        )
    )


def signal_levels(df: DataFrame, column: str, key: str = "clip_id") -> DataFrame:
    """Per clip: peak, RMS, share of clipped and of active samples (above 1.5 % of the peak)."""
    x = F.col(column)
    peaks = df.groupBy(key).agg(F.max(F.abs(x)).alias("peak"))
    quiet = F.greatest(F.col("peak") * 0.015, F.lit(1e-5))
    return (
        df.join(peaks, key)
        .groupBy(key)
        .agg(
            F.max("peak").alias("peak"),
            F.sqrt(F.avg(x * x)).alias("rms"),
            F.avg((F.abs(x) >= 0.999).cast("double")).alias("clipped"),
            F.avg((F.abs(x) > quiet).cast("double")).alias("active"),
        )
    )


def encoding_traces(
    df: DataFrame, column: str, key: str = "clip_id", index: str = "frame_idx"
) -> DataFrame:
    """Per clip: clipped and near-zero shares, and the share of repeats and of distinct values among
    its 16-bit levels."""
    x = F.col(column)
    level = F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.rint(x * 32768))).cast("int")
    levels = df.withColumn("level", level)
    pairs = with_previous(levels, "level", key, index)
    same = F.when(F.col("prev_level").isNotNull(), (F.col("level") == F.col("prev_level")).cast("double"))
    repeats = pairs.groupBy(key).agg(F.coalesce(F.avg(same), F.lit(0.0)).alias("repeat_fraction"))
    # Distinct levels through a (clip, level) pre-aggregate: at most 65,536 rows per clip.
    per_level = levels.groupBy(key, "level").agg(F.count("*").alias("n"))
    unique = per_level.groupBy(key).agg((F.count("*") / F.sum("n")).alias("unique_fraction"))
    shares = df.groupBy(key).agg(
        F.avg((F.abs(x) >= 0.999).cast("double")).alias("clip_fraction"),
        F.avg((F.abs(x) < 1e-7).cast("double")).alias("zero_fraction"),
    )
    return shares.join(repeats, key).join(unique, key)
