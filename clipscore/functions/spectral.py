"""Frame measures as Column expressions over a magnitude spectrum (array of doubles).

These are the definitions the SQL checks run against.  The clip job computes the same measures with
numpy inside its Arrow task, because folding 513 bins in the JVM costs far more than the transform.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipscore.functions.audio import FLOOR, cosines, linear_bank
from clipscore.functions.vectors import dot, let, total


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _squares(mag: Column) -> Column:
    return F.transform(mag, lambda v: v * v)


def rms(mag: Column, bins: int) -> Column:
    """Root mean square from one-sided magnitudes; the first and last bin count half."""
    size = 2 * (bins - 1)
    halves = F.transform(
        mag, lambda v, i: v * v * F.when((i == 0) | (i == bins - 1), 0.5).otherwise(1.0)
    )
    return F.sqrt(total(halves) * (2.0 / size**2))


def centroid(mag: Column, step: float) -> Column:
    """Magnitude-weighted mean frequency; bin i stands for ``i * step`` Hz."""
    weighted = total(F.transform(mag, lambda v, i: v * i)) * step
    return F.coalesce(F.try_divide(weighted, total(mag)), F.lit(0.0))


def bandwidth(mag: Column, step: float) -> Column:
    """Magnitude-weighted deviation around the centroid: second moment minus squared mean."""
    mean = centroid(mag, step)
    second = total(F.transform(mag, lambda v, i: v * i * i)) * (step * step)
    spread = F.coalesce(F.try_divide(second, total(mag)), F.lit(0.0)) - mean * mean
    return F.sqrt(F.greatest(spread, F.lit(0.0)))


def _bins_below(values: Column, target: Column) -> Column:
    """How many leading bins have a running sum below ``target``: one fold, no running array."""

    def count(goal: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

        def step(s: Column, v: Column) -> Column:
            run = s["sum"] + v
            return F.struct(run.alias("sum"), (s["n"] + (run < goal).cast("int")).alias("n"))

        return F.aggregate(values, start, step, lambda s: s["n"])

    return let(target, count)


def rolloff(mag: Column, step: float, share: float = 0.85) -> Column:
    """Lowest frequency whose cumulative magnitude reaches ``share`` of the total."""
    return _bins_below(mag, total(mag) * share) * step


def flatness(mag: Column, bins: int) -> Column:
    """Geometric over arithmetic mean of the floored power."""
    power = F.transform(mag, lambda v: F.greatest(v * v, F.lit(FLOOR)))
    logs = total(F.transform(power, lambda p: F.ln(p)))
    return F.exp(logs / bins) / (total(power) / bins)


def shares(mag: Column) -> Column:
    """Spectrum divided by its (floored) sum."""
    scale = F.greatest(total(mag), F.lit(FLOOR))
    return let(scale, lambda t: F.transform(mag, lambda v: v / t))


def flux(mag: Column, previous: Column) -> Column:
    """Distance between two sum-normalized spectra; 0 without a previous one."""
    gaps = F.zip_with(shares(mag), shares(previous), lambda a, b: (a - b) * (a - b))
    return F.when(previous.isNull(), 0.0).otherwise(F.sqrt(total(gaps)))


def band_share(mag: Column, step: float, low: float, high: float) -> Column:
    """Share of the power in [low, high) Hz."""
    lo, hi = math.ceil(low / step), math.ceil(high / step)
    part = F.slice(mag, lo + 1, max(hi - lo, 0))
    return total(_squares(part)) / F.greatest(total(_squares(mag)), F.lit(FLOOR))


def cutoff_bin(energy: Column, share: float = 0.99) -> Column:
    """First bin whose cumulative energy reaches ``share`` of the (floored) total."""
    n = _bins_below(energy, F.greatest(total(energy), F.lit(FLOOR)) * share)
    return F.least(n, F.size(energy) - 1)


def dct(values: Column, n: int, keep: int) -> Column:
    """First coefficients of the orthonormal DCT-II."""
    rows = F.array(*[literal(row) for row in cosines(n, keep)])
    return let(values, lambda x: F.transform(rows, lambda row: dot(row, x)))


def bank_energy(mag: Column, filters: int, bins: int) -> Column:
    """Log energy in equal-width triangular filters."""
    rows = F.array(*[literal(row) for row in linear_bank(filters, bins)])

    def energies(power: Column) -> Column:
        return F.transform(rows, lambda row: F.ln(F.greatest(dot(row, power), F.lit(FLOOR))))

    return let(_squares(mag), energies)
