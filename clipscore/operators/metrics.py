"""Detection metrics over (keys, label, score): one curve table, every metric an aggregate of it.

Scores increase towards synthetic (label 1); a clip is called synthetic at ``score >= t``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipscore.operators.ordered import HOT_ROWS, RANGES, running, score_range


@dataclass(frozen=True)
class Costs:
    """Detection-cost parameters; the normalizer is the cheaper constant decision."""

    p_spoof: float = 0.3
    c_miss: float = 1.0
    c_fa: float = 4.0

    def __post_init__(self) -> None:
        finite = all(abs(v) < float("inf") for v in (self.p_spoof, self.c_miss, self.c_fa))
        if not finite or not 0 < self.p_spoof < 1:
            raise ValueError("p_spoof must lie strictly between 0 and 1")
        if self.c_miss <= 0 or self.c_fa <= 0:
            raise ValueError("costs must be positive and finite")

    @property
    def miss_weight(self) -> float:
        return self.c_miss * self.p_spoof

    @property
    def fa_weight(self) -> float:
        return self.c_fa * (1 - self.p_spoof)

    @property
    def normalizer(self) -> float:
        return min(self.miss_weight, self.fa_weight)

    def of(self, miss: Column, fa: Column) -> Column:
        return (self.miss_weight * miss + self.fa_weight * fa) / self.normalizer


DEFAULT = Costs()


def score_curve(
    df: DataFrame,
    keys: list[str],
    label: str = "label",
    score: str = "score",
    ranges: int = RANGES,
    weight: str | None = None,
) -> DataFrame:
    """One row per (keys, distinct score) with cumulative class counts.

    Columns: ``real``/``spoof`` at this score, ``*_before`` strictly below it, ``*_total`` and
    ``prev_*`` at the next lower score.  Equal scores are merged before the shuffle; a
    key's curve is cut into ``ranges`` of its scores, whatever its size.  ``weight`` names a column that
    says how many clips a row stands for.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    points = df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum((1 - F.col(label)) * times).alias("real"), F.sum(F.col(label) * times).alias("spoof")
    )
    return running(
        points,
        keys,
        ["score"],
        {"real": F.col("real"), "spoof": F.col("spoof")},
        prev=["real", "spoof"],
        place=score_range(F.col("score").cast("double"), ranges),
    )


def _rates(curve: DataFrame) -> DataFrame:
    """Add decision rates at threshold = score: misses below it, false alarms at or above."""
    called = F.col("real_total") - F.col("real_before")
    return curve.withColumn(
        "miss", F.try_divide(F.col("spoof_before"), F.col("spoof_total"))
    ).withColumn("fa", F.try_divide(called, F.col("real_total")))


def _both_classes() -> Column:
    return (F.max("real_total") > 0) & (F.max("spoof_total") > 0)


def min_dcf_of_curve(curve: DataFrame, keys: list[str], costs: Costs = DEFAULT) -> DataFrame:
    """Minimum normalized cost per key, lowest threshold on ties.

    Candidates are each distinct score plus one cutoff just above the maximum (accept every clip).
    A key holding one class only has no cost: nulls plus a ``reason``.
    """
    best = F.min(F.struct(costs.of(F.col("miss"), F.col("fa")).alias("cost"), "score"))
    accept_cost = costs.of(F.lit(1.0), F.lit(0.0))
    found = _rates(curve).groupBy(*keys).agg(
        best.alias("best"), F.max("score").alias("top"), _both_classes().alias("valid")
    )
    accept = F.col("valid") & (accept_cost < F.col("best.cost"))
    above = F.expr("cast(java_method('java.lang.Math', 'nextUp', top) as double)")
    return found.select(
        *keys,
        F.when(F.col("valid"), F.least("best.cost", accept_cost)).alias("min_dcf"),
        F.when(accept, above).when(F.col("valid"), F.col("best.score")).alias("threshold"),
        accept.alias("accept_all"),
        F.when(~F.col("valid"), "one class only").alias("reason"),
    )


def min_dcf(
    df: DataFrame,
    keys: list[str],
    label: str = "label",
    score: str = "score",
    costs: Costs = DEFAULT,
    ranges: int = RANGES,
    weight: str | None = None,
) -> DataFrame:
    return min_dcf_of_curve(score_curve(df, keys, label, score, ranges, weight), keys, costs)


def min_dcf_value(
    df: DataFrame, label: str = "label", score: str = "score", costs: Costs = DEFAULT
) -> tuple[float, float]:
    """The single (cost, threshold) of a scored table; raises where the metric is undefined."""
    s = F.col(score)
    bad = df.agg(
        F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))).alias("bad"),
        F.count_if(~F.col(label).isin(0, 1) | F.col(label).isNull()).alias("labels"),
        F.count_distinct(label).alias("classes"),
    ).first()
    if bad["labels"] or bad["classes"] != 2:
        raise ValueError("minDCF needs both labels (0 real, 1 synthetic)")
    if bad["bad"]:
        raise ValueError("scores must be finite")
    row = min_dcf(df, [], label, score, costs).first()
    return row["min_dcf"], row["threshold"]


def dcf_at(
    df: DataFrame,
    keys: list[str],
    cutoff: Column | float,
    label: str = "label",
    score: str = "score",
    costs: Costs = DEFAULT,
) -> DataFrame:
    """Normalized cost at a fixed cutoff (plus or minus infinity allowed, NaN rejected)."""
    if isinstance(cutoff, (int, float)):
        if cutoff != cutoff:
            raise ValueError("cutoff must not be NaN")
        cutoff = F.lit(float(cutoff))
    hit = (F.col(score) >= cutoff).cast("double")
    return (
        df.groupBy(*keys)
        .agg(
            F.avg(F.when(F.col(label) == 1, 1 - hit)).alias("miss"),
            F.avg(F.when(F.col(label) == 0, hit)).alias("fa"),
        )
        .withColumn("dcf", costs.of(F.col("miss"), F.col("fa")))
    )


def roc_points(curve: DataFrame, keys: list[str]) -> DataFrame:
    """ROC points from (0, 0), at an infinite threshold, with interior collinear points dropped.

    Walking down, the step into a point is its own (real, spoof) and the step out is the next
    lower score's; the point is redundant exactly when both steps are equal.
    """
    first = F.col("real_before") + F.col("real") == F.col("real_total")
    first &= F.col("spoof_before") + F.col("spoof") == F.col("spoof_total")
    corner = (F.col("prev_real") != F.col("real")) | (F.col("prev_spoof") != F.col("spoof"))
    own = F.struct(F.col("score").cast("double").alias("threshold"), F.col("fa").alias("fpr"), (1 - F.col("miss")).alias("tpr"))
    origin = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    points = F.when(first, F.array(origin, own)).otherwise(F.array(own))
    return _rates(curve).where(first | F.col("prev_real").isNull() | corner).select(*keys, F.inline(points))


def eer(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Equal error rate: mean of the two rates where they differ least, highest threshold first."""
    gap = F.abs(F.col("fpr") - (1 - F.col("tpr")))
    value = (F.col("fpr") + (1 - F.col("tpr"))) / 2
    return (
        roc_points(curve, keys)
        .groupBy(*keys)
        .agg(F.min(F.struct(gap, -F.col("threshold"), value.alias("eer"))).alias("m"))
        .select(*keys, F.col("m.eer").alias("eer"))
    )


def _area() -> Column:
    """ROC area: each synthetic clip beats the real clips below it, and half of those tied."""
    wins = F.col("spoof") * (F.col("real_before") + F.col("real") / 2)
    return F.try_divide(F.sum(wins), F.max("real_total").cast("double") * F.max("spoof_total"))


def _average_precision() -> Column:
    tp = F.col("spoof_total") - F.col("spoof_before")
    called = tp + F.col("real_total") - F.col("real_before")
    return F.sum(F.try_divide(F.col("spoof"), F.col("spoof_total")) * (tp / called))


def auc(curve: DataFrame, keys: list[str]) -> DataFrame:
    return curve.groupBy(*keys).agg(F.when(_both_classes(), _area()).alias("auc"))


def average_precision(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision: sum over distinct scores of recall step times precision (no trapezoid)."""
    return curve.groupBy(*keys).agg(
        F.when(F.max("spoof_total") > 0, _average_precision()).alias("ap")
    )


def summary(
    df: DataFrame,
    keys: list[str],
    label: str = "label",
    score: str = "score",
    costs: Costs = DEFAULT,
    ranges: int = RANGES,
) -> DataFrame:
    """minDCF, its threshold and error rates, EER, AUC and AP per key, in one aggregation.

    All of them reduce over the same curve, so the curve is shuffled once; the rates at the
    minDCF threshold ride along in the struct that ``min`` picks.
    """
    curve = _rates(score_curve(df, keys, label, score, ranges))
    first = F.col("real_before") + F.col("real") == F.col("real_total")
    first &= F.col("spoof_before") + F.col("spoof") == F.col("spoof_total")
    corner = (F.col("prev_real") != F.col("real")) | (F.col("prev_spoof") != F.col("spoof"))
    kept = first | F.col("prev_real").isNull() | corner
    point = F.struct(
        F.abs(F.col("fa") - F.col("miss")),
        -F.col("score"),
        ((F.col("fa") + F.col("miss")) / 2).alias("eer"),
    )
    best = F.struct(
        costs.of(F.col("miss"), F.col("fa")).alias("cost"), F.col("score").alias("t"), "fa", "miss"
    )
    accept_cost = costs.of(F.lit(1.0), F.lit(0.0))
    found = curve.groupBy(*keys).agg(
        F.min(best).alias("best"),
        F.min(F.when(kept, point)).alias("point"),
        F.max("score").alias("top"),
        _area().alias("auc"),
        _average_precision().alias("ap"),
        _both_classes().alias("valid"),
    )
    accept = accept_cost < F.col("best.cost")
    above = F.expr("cast(java_method('java.lang.Math', 'nextUp', top) as double)")

    def valid(value: Column) -> Column:
        return F.when(F.col("valid"), value)

    return found.select(
        *keys,
        valid(F.least("best.cost", accept_cost)).alias("min_dcf"),
        valid(F.when(accept, above).otherwise(F.col("best.t"))).alias("threshold"),
        valid(F.when(accept, 0.0).otherwise(F.col("best.fa"))).alias("far"),
        valid(F.when(accept, 1.0).otherwise(F.col("best.miss"))).alias("miss"),
        valid(F.col("point.eer")).alias("eer"),
        valid(F.col("auc")).alias("auc"),
        valid(F.col("ap")).alias("ap"),
        F.when(~F.col("valid"), "one class only").alias("reason"),
    )


def confusion(
    df: DataFrame, keys: list[str], cutoff: float = 0.5, label: str = "label", score: str = "score"
) -> DataFrame:
    """Counts of the four outcomes, accuracy and balanced accuracy at a cutoff."""
    y, hit = F.col(label) == 1, F.col(score) >= cutoff
    return (
        df.groupBy(*keys)
        .agg(
            F.count_if(~y & ~hit).alias("tn"),
            F.count_if(~y & hit).alias("fp"),
            F.count_if(y & ~hit).alias("fn"),
            F.count_if(y & hit).alias("tp"),
        )
        .withColumn("accuracy", F.expr("(tn + tp) / (tn + fp + fn + tp)"))
        .withColumn(
            "balanced_accuracy", F.expr("(try_divide(tp, tp + fn) + try_divide(tn, tn + fp)) / 2")
        )
    )


def stability(df: DataFrame, keys: list[str], a: str, b: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Paired scores: count, mean and largest absolute change, Spearman rank correlation.

    Ranks with ties come from merged distinct scores: average rank = before + (n + 1) / 2.
    """

    def average_rank(score: str, name: str) -> DataFrame:
        points = df.groupBy(*keys, score).agg(F.count("*").alias("n"))
        out = running(points, keys, [score], {"n": F.col("n")}, hot_rows=hot_rows)
        return out.select(*keys, score, (F.col("n_before") + (F.col("n") + 1) / 2).alias(name))

    pairs = df.groupBy(*keys, a, b).agg(F.count("*").alias("w"))
    change = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_change"),
        F.max(F.abs(F.col(a) - F.col(b))).alias("max_change"),
    )
    joined = pairs.join(average_rank(a, "ra"), [*keys, a]).join(average_rank(b, "rb"), [*keys, b])

    def mean(e: Column) -> Column:
        return F.sum(e * F.col("w")) / F.sum("w")

    x, y = F.col("ra"), F.col("rb")
    moments = joined.groupBy(*keys).agg(
        (mean(x * y) - mean(x) * mean(y)).alias("cov"),
        (mean(x * x) - mean(x) * mean(x)).alias("vx"),
        (mean(y * y) - mean(y) * mean(y)).alias("vy"),
    )
    corr = F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("cov") / F.sqrt(F.col("vx") * F.col("vy")))
    out = moments.select(*keys, corr.alias("rank_correlation"))
    if keys:
        return change.join(out, keys)
    return change.withColumn("rank_correlation", out.scalar())


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalized mutual information of two partitions of the same rows."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))

    def sums(col: str | None) -> DataFrame:
        t = cells.groupBy(col).agg(F.sum("n").alias("n")) if col else cells
        return t.select(F.lit(col or "ab").alias("side"), F.col("n").cast("double").alias("n"))

    sides = sums(None).unionByName(sums(a)).unionByName(sums(b))

    def of(side: str, e: Column) -> Column:
        return F.sum(F.when(F.col("side") == side, e))

    n = F.col("n")
    pairs, plogp = n * (n - 1) / 2, n * F.ln(n)
    t = sides.agg(
        of("ab", n).alias("total"),
        of("ab", pairs).alias("joint"),
        of(a, pairs).alias("pa"),
        of(b, pairs).alias("pb"),
        of("ab", plogp).alias("lab"),
        of(a, plogp).alias("la"),
        of(b, plogp).alias("lb"),
    )
    # With S = sum n ln n: entropy H = ln N - S/N, mutual information = H_a + H_b - H_ab.
    return (
        t.withColumn("expected", F.expr("coalesce(try_divide(pa * pb, total * (total - 1) / 2), 0.0D)"))
        .withColumn("ha", F.expr("ln(total) - la / total"))
        .withColumn("hb", F.expr("ln(total) - lb / total"))
        .withColumn("mi", F.expr("ln(total) + (lab - la - lb) / total"))
        .select(
            F.expr(
                "CASE WHEN (pa + pb) / 2 = expected THEN 1.0D "
                "ELSE (joint - expected) / ((pa + pb) / 2 - expected) END"
            ).alias("adjusted_rand"),
            F.expr("CASE WHEN ha + hb = 0 THEN 1.0D ELSE mi / ((ha + hb) / 2) END").alias("nmi"),
        )
    )
