"""Column expressions on fixed-width feature vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names and order of the five feature views.
BASE_SERIES = (
    "zcr", "rms", "spectral_centroid", "spectral_bandwidth", "spectral_rolloff_85",
    "spectral_flatness", "spectral_flux", "low_band_energy", "mid_band_energy", "high_band_energy",
)
TEMPORAL_SERIES = (
    "rms", "zcr", "centroid", "flatness", "flux", "low_energy", "mid_energy", "high_energy",
)
ENCODING_HEADER = (
    "is_wav", "pcm_format", "channels", "source_sample_rate", "bits_per_sample",
    "source_bytes_per_second", "log_file_bytes_per_second",
)
ENCODING_SIGNAL = (
    "clip_fraction", "zero_fraction", "repeat_sample_fraction", "unique_level_fraction",
    "high_frequency_fraction", "spectral_cutoff_fraction", "spectral_flatness",
)
QUALITY = (
    "duration_seconds", "peak_level", "rms_level", "clipped_fraction", "active_fraction",
    "spectral_flatness", "high_frequency_fraction", "low_frequency_fraction", "spectral_flux",
    "bytes_per_second", "has_metadata", "has_encoder_tag",
)

WINDOWS = 8
N_MFCC = N_LFCC = 20
N_CHROMA = 12


def _both(name: str) -> tuple[str, str]:
    return f"{name}_mean", f"{name}_std"


BASE = tuple(
    n
    for stem in (
        *BASE_SERIES,
        *(f"mfcc_{i:02d}" for i in range(1, N_MFCC + 1)),
        *(f"chroma_{i:02d}" for i in range(N_CHROMA)),
    )
    for n in _both(stem)
)
LFCC = tuple(
    n
    for part in ("static", "delta", "delta2")
    for i in range(1, N_LFCC + 1)
    for n in _both(f"lfcc_{part}_{i:02d}")
)
TEMPORAL = tuple(
    n for b in range(WINDOWS) for s in TEMPORAL_SERIES for n in _both(f"bin_{b:02d}_{s}")
) + tuple(f"trend_{s}" for s in TEMPORAL_SERIES)
ENCODING = ENCODING_HEADER + ENCODING_SIGNAL
VIEWS = {"base": BASE, "lfcc": LFCC, "temporal": TEMPORAL, "encoding": ENCODING, "quality": QUALITY}

# Parts of the base view that can be asked for alone.
PARTS = {part: tuple(n for n in BASE if n.startswith(f"{part}_")) for part in ("mfcc", "chroma")}


def is_sound(vector: Column, width: int) -> Column:
    """Exact width and every element finite."""
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def pick(vector: Column, positions: list[int]) -> Column:
    """Elements at ascending zero-based positions.  The vector is the argument of the filter, not
    part of its lambda, so an expression behind it is evaluated once and not per element."""
    if sorted(set(positions)) != list(positions):
        raise ValueError("positions must ascend")
    wanted = set(positions)
    keep = F.array(*[F.lit(i in wanted) for i in range(max(positions, default=0) + 1)])
    return F.filter(vector, lambda _, i: F.coalesce(F.get(keep, i), F.lit(False)))


def pick_by_name(vector: Column, names: tuple[str, ...], keep) -> Column:
    """Elements whose feature name satisfies ``keep``."""
    return pick(vector, [i for i, name in enumerate(names) if keep(name)])


def spectral_part(base: Column) -> Column:
    """The base features that are neither MFCC nor chroma."""
    return pick_by_name(base, BASE, lambda n: not n.startswith(("mfcc_", "chroma_")))


def header_part(encoding: Column) -> Column:
    return F.slice(encoding, 1, len(ENCODING_HEADER))


def signal_part(encoding: Column) -> Column:
    return F.slice(encoding, len(ENCODING_HEADER) + 1, len(ENCODING_SIGNAL))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def let(value: Column, use) -> Column:
    """Bind an expression to a lambda variable.  An outer expression mentioned inside a lambda body
    is evaluated for every element (the optimizer may inline a projected column there as well); as
    the argument of this one-element transform it is evaluated once per row."""
    return F.get(F.transform(F.array(value), use), 0)
