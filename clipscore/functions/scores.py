"""Column expressions on labels and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted label texts.
LABELS = {
    "0": 0, "real": 0, "bonafide": 0, "bona fide": 0,
    "1": 1, "synthetic": 1, "spoof": 1, "fake": 1,
}

# Fixed value: how far a coherent container pulls a score towards real.
REAL_WEIGHT = 0.05


def label_of(text: Column) -> Column:
    """0 real, 1 synthetic, null for any other text (trimmed, case-blind)."""
    known = F.create_map(*[F.lit(v) for pair in LABELS.items() for v in pair])
    return known[F.lower(F.trim(text))].cast("int")


def label_text(label: Column) -> Column:
    return F.when(label == 1, "synthetic").otherwise("real")


def in_unit(value: Column) -> Column:
    """True for a finite number in [0, 1]; nulls and NaN are false."""
    return F.coalesce(~F.isnan(value) & (value >= 0) & (value <= 1), F.lit(False))


def check_weight(value: float, name: str) -> float:
    if not 0 <= value <= 1:
        raise ValueError(f"{name} must lie in [0, 1]")
    return float(value)


def container_adjusted(score: Column, status: Column, real_weight: float = REAL_WEIGHT) -> Column:
    """Pull the score towards real only where the container is coherent; null if out of range."""
    check_weight(real_weight, "real_weight")
    pulled = F.when(status == "consistent", score * (1.0 - real_weight)).otherwise(score)
    return F.when(in_unit(score), pulled)


def blend(weighted: list[tuple[float, Column]]) -> Column:
    """Weighted sum of scores."""
    out = F.lit(0.0)
    for weight, score in weighted:
        out = out + F.lit(float(weight)) * score
    return out


def mix(weight: Column | float, a: Column, b: Column) -> Column:
    """``weight * a + (1 - weight) * b`` clipped to [0, 1]."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), w * a + (1.0 - w) * b))


def fallback_score(first: Column, second: Column, alpha: Column) -> Column:
    """Second scorer missing: the first alone.  No routing weight: equal halves.  Else routed."""
    return F.when(second.isNull(), first).otherwise(mix(F.coalesce(alpha, F.lit(0.5)), first, second))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case text after the last dot of the basename, with the dot; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def last_part(text: Column, by: str = ":") -> Column:
    return F.substring_index(text, by, -1)
