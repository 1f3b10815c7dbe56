"""Small numpy helpers used inside Arrow tasks: PCM bytes to samples, spectra, filter banks."""

from __future__ import annotations

import math
from functools import cache

import numpy as np

# Signal conventions.
RATE = 16_000
MIN_SAMPLES = RATE // 2
MIN_PEAK = 1e-6
FLOOR = 1e-10
N_MELS, N_MFCC, N_CHROMA, N_LFCC, N_LINEAR = 128, 20, 12, 20, 64
TOP_DB = 80.0


def pcm_samples(content: bytes, seconds: int | None = None) -> tuple[np.ndarray, int]:
    """A RIFF PCM file, or its first ``seconds``, as mono floats, with the sample rate."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    pos, fmt, body = 12, None, None
    while pos + 8 <= len(content) and (fmt is None or body is None):
        size = int.from_bytes(content[pos + 4 : pos + 8], "little")
        chunk = slice(pos + 8, min(pos + 8 + size, len(content)))
        if content[pos : pos + 4] == b"fmt ":
            fmt = content[chunk]
        elif content[pos : pos + 4] == b"data":
            body = memoryview(content)[chunk]
        pos += 8 + size + size % 2
    if fmt is None or body is None or len(fmt) < 16:
        raise ValueError("format or data chunk missing")
    code, channels, rate, bits = np.frombuffer(fmt[:16], "<u2")[[0, 1, 2, 7]].tolist()
    rate = int.from_bytes(fmt[4:8], "little")
    width = bits // 8
    if code not in (1, 3) or bits % 8 or not 1 <= channels or not rate or width not in (1, 2, 3, 4):
        raise ValueError("only integer or 32-bit float PCM is supported")
    frame = width * channels
    frames = len(body) // frame if seconds is None else min(len(body) // frame, rate * seconds)
    body = body[: frames * frame]
    if code == 3:
        if width != 4:
            raise ValueError("only 32-bit float PCM is supported")
        values = np.frombuffer(body, "<f4").astype(np.float64)
    elif width == 1:
        values = (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        whole = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
        values = (whole - ((whole & 0x800000) << 1)) / float(1 << 23)
    else:
        values = np.frombuffer(body, f"<i{width}") / float(1 << (bits - 1))
    return values.reshape(-1, channels).mean(axis=1), rate


def resampled(x: np.ndarray, rate: int, half: int = 16) -> np.ndarray:
    """Linear-phase windowed-sinc conversion to 16 kHz.

    Outputs of one phase share their filter taps, so each phase is one product of strided input
    windows with a tap vector.
    """
    if rate == RATE or not len(x):
        return x
    up, down = RATE // math.gcd(RATE, rate), rate // math.gcd(RATE, rate)
    n = math.ceil(len(x) * RATE / rate)
    cut = min(1.0, RATE / rate)
    reach = math.ceil(half / cut)
    taps = np.arange(1 - reach, reach + 1)
    padded = np.concatenate((np.zeros(reach - 1), x, np.zeros(reach + 1)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach)
    out = np.empty(n)
    for phase in range(min(up, n)):
        start, left = divmod(phase * down, up)
        gap = taps - left / up
        h = cut * np.sinc(cut * gap) * np.where(
            np.abs(gap) < reach, 0.5 + 0.5 * np.cos(np.pi * gap / reach), 0.0
        )
        count = len(range(phase, n, up))
        if down == 1:  # neighbouring windows: products of shifted rows need no windows in memory
            out[phase::up] = np.correlate(padded[start : start + count + 2 * reach - 1], h, "valid")
        else:
            out[phase::up] = windows[start : start + (count - 1) * down + 1 : down] @ h
    return out


def rejection(x: np.ndarray) -> str | None:
    """Why a waveform is not admitted, or None."""
    if x.ndim != 1 or x.size < MIN_SAMPLES:
        return "under half a second of mono sound"
    if not np.isfinite(x).all() or np.abs(x).max() < MIN_PEAK:
        return "silence or non-finite samples"
    return None


def decode(content: bytes, seconds: int | None = None) -> np.ndarray:
    """The whole clip at 16 kHz, or its first ``seconds``."""
    x, rate = pcm_samples(content, seconds)
    return resampled(x, rate)


def lowpass(x: np.ndarray, cutoff: float, pad: int = 4096) -> np.ndarray:
    """Zero-phase order-6 Butterworth run both ways: its squared magnitude applied in frequency,
    with odd extension at the ends."""
    if not 0 < cutoff < RATE / 2:
        raise ValueError("cutoff must lie strictly between 0 and half the sample rate")
    pad = min(pad, len(x) - 1)
    # Transforms of lengths with large prime factors cost several times those of smooth ones: the right end is
    # extended further, by at most what there is to mirror.
    more = min(_smooth(len(x) + 2 * pad) - len(x) - pad, len(x) - 1)
    left = 2 * x[0] - x[pad:0:-1]
    right = 2 * x[-1] - x[-2 : -more - 2 : -1]
    y = np.concatenate((left, x, right))
    f = np.fft.rfftfreq(len(y), 1 / RATE)
    with np.errstate(over="ignore"):
        ratio = np.tan(np.pi * np.minimum(f, RATE / 2 - 1e-9) / RATE) / math.tan(math.pi * cutoff / RATE)
        fourth = (ratio * ratio) ** 2
        gain = 1 / (1 + fourth * fourth * fourth)
    return np.fft.irfft(np.fft.rfft(y) * gain, len(y))[pad : pad + len(x)]


def _smooth(n: int) -> int:
    """The smallest number from ``n`` on of the form 2^a 3^b 5^c."""
    best, five = 1 << (n - 1).bit_length(), 1
    while five < best:
        three = five
        while three < best:
            best = min(best, three << max(0, (-(-n // three) - 1).bit_length()))
            three *= 3
        five *= 5
    return best


def framed(x: np.ndarray, size: int, hop: int, mode: str = "constant") -> np.ndarray:
    """Centred frames: 1 + n // hop of them."""
    padded = np.pad(x, size // 2, mode=mode)
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::hop][: 1 + len(x) // hop]


@cache
def hann(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def magnitudes(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Hann magnitude spectra, one row per frame."""
    return np.abs(np.fft.rfft(framed(x, size, hop) * hann(size), axis=1))


def crossings(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Share of sign changes per frame; magnitudes up to 1e-10 count as zero, zero as positive."""
    negative = np.pad(x < -FLOOR, size // 2, mode="edge")
    run = np.concatenate(([0], np.cumsum(negative[1:] != negative[:-1])))  # changes up to a sample
    first = np.arange(1 + len(x) // hop) * hop
    return (run[first + size - 1] - run[first]) / size


def flux(mag: np.ndarray) -> np.ndarray:
    """Distance between successive sum-normalized spectra; 0 for the first."""
    share = mag / np.maximum(mag.sum(axis=1, keepdims=True), FLOOR)
    gap = share[1:] - share[:-1]
    return np.concatenate(([0.0], np.sqrt(np.einsum("fb,fb->f", gap, gap))))


def flatness(mag: np.ndarray, power: np.ndarray | None = None) -> np.ndarray:
    power = np.maximum(mag**2 if power is None else power, FLOOR)
    bins, part, logs = power.shape[1], power, 0.0
    if power.max(initial=0.0) < 1e18:  # products of 16 bins stay within range: a sixteenth of the logarithms
        for _ in range(4):
            half = part.shape[1] // 2
            if part.shape[1] % 2:
                logs = logs + np.log(part[:, -1])
            part = part[:, :half] * part[:, half : 2 * half]
    return np.exp((logs + np.log(part).sum(axis=1)) / bins) / power.mean(axis=1)


def band_shares(mag: np.ndarray, freqs: np.ndarray, power: np.ndarray | None = None) -> list[np.ndarray]:
    """Relative power below 500 Hz, from 500 to 2,000 Hz and above."""
    power = mag**2 if power is None else power
    total = np.maximum(power.sum(axis=1), FLOOR)
    edges = np.searchsorted(freqs, (0, 500, 2_000, RATE))
    return [power[:, a:b].sum(axis=1) / total for a, b in zip(edges[:-1], edges[1:])]


def rms(mag: np.ndarray, size: int, power: np.ndarray | None = None) -> np.ndarray:
    power = mag**2 if power is None else power
    return np.sqrt(2 * (power.sum(axis=1) - 0.5 * (power[:, 0] + power[:, -1]))) / size


def centroid(mag: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    total = mag.sum(axis=1)
    return np.divide(mag @ freqs, total, out=np.zeros(len(mag)), where=total > 0)


def bandwidth(mag: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    total = np.where((t := mag.sum(axis=1)) > 0, t, 1.0)
    gap = freqs[None, :] - centroid(mag, freqs)[:, None]
    return np.sqrt(np.einsum("fb,fb,fb->f", mag, gap, gap) / total)


def rolloff(mag: np.ndarray, freqs: np.ndarray, share: float = 0.85) -> np.ndarray:
    run = np.cumsum(mag, axis=1)
    return freqs[(run >= share * run[:, -1:]).argmax(axis=1)]


@cache
def cosines(n: int, keep: int) -> np.ndarray:
    """First rows of the orthonormal DCT-II of length n."""
    k = np.arange(keep)[:, None]
    basis = np.cos(np.pi * k * (2 * np.arange(n) + 1) / (2 * n)) * math.sqrt(2 / n)
    basis[0] /= math.sqrt(2)
    return basis


@cache
def linear_bank(filters: int, bins: int) -> np.ndarray:
    """Triangles of equal width in Hz, each row summing to one."""
    x = np.linspace(0, filters + 1, bins)
    bank = np.clip(1 - np.abs(x[None, :] - np.arange(1, filters + 1)[:, None]), 0, None)
    return bank / np.maximum(bank.sum(axis=1, keepdims=True), FLOOR)


@cache
def mel_bank(size: int) -> np.ndarray:
    """Area-normalized triangles on the piecewise linear/log mel scale."""
    step, knee = 200 / 3, 1000.0
    ratio = math.log(6.4) / 27

    def to_hz(m: np.ndarray) -> np.ndarray:
        return np.where(m < knee / step, m * step, knee * np.exp(ratio * (m - knee / step)))

    top = knee / step + math.log(RATE / 2 / knee) / ratio
    hz = to_hz(np.linspace(0, top, N_MELS + 2))
    f = np.fft.rfftfreq(size, 1 / RATE)
    up = (f[None, :] - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None]
    down = (hz[2:, None] - f[None, :]) / (hz[2:] - hz[1:-1])[:, None]
    return np.clip(np.minimum(up, down), 0, None) * (2 / (hz[2:] - hz[:-2]))[:, None]


def mfcc(power: np.ndarray, size: int) -> np.ndarray:
    """Cepstra of mel power in decibels, floored 80 dB below the clip's maximum."""
    db = 10 * np.log10(np.maximum(power @ mel_bank(size).T, FLOOR))
    return np.maximum(db, db.max() - TOP_DB) @ cosines(N_MELS, N_MFCC).T


@cache
def chroma_bank(size: int, tuning: float) -> np.ndarray:
    """Gaussian pitch-class weights per bin, unit column norm, damped away from the fifth octave."""
    n = N_CHROMA
    hz = np.arange(1, size) * RATE / size
    octave = np.log2(hz / (440.0 * 2 ** (tuning / n) / 16))
    pitch = np.concatenate(([n * (octave[0] - 1.5)], n * octave))
    width = np.concatenate((np.maximum(np.diff(pitch), 1.0), [1.0]))
    gap = (pitch[None, :] - np.arange(n)[:, None] + n / 2) % n - n / 2
    bank = np.exp(-0.5 * (2 * gap / width[None, :]) ** 2)
    bank /= np.linalg.norm(bank, axis=0, keepdims=True)
    bank *= np.exp(-0.5 * ((pitch / n - 5.0) / 2.0) ** 2)[None, :]
    return np.roll(bank, -3, axis=0)[:, : size // 2 + 1]


def tuning_of(power: np.ndarray, size: int) -> float:
    """Deviation from A440 in semitone fractions: the fullest of 100 bins over interpolated
    spectral peaks at or above the median peak power, 150 to 4,000 Hz."""
    low, high = math.ceil(150 * size / RATE), math.ceil(4_000 * size / RATE)
    left, here, right = (power[:, low + d : high + d] for d in (-1, 0, 1))
    floor = 0.1 * power.max(axis=1, keepdims=True)
    a, b, c = (np.where(p > floor, p, 0.0) for p in (left, here, right))
    rows, cols = np.nonzero((b > a) & (b >= c))
    if not len(rows):
        return 0.0
    left, here, right = left[rows, cols], here[rows, cols], right[rows, cols]
    slope, curve = (right - left) / 2, right + left - 2 * here
    shift = np.divide(-slope, curve, out=np.zeros_like(here), where=np.abs(slope) < np.abs(curve))
    pitch = (cols + low + shift) * RATE / size
    height = here + 0.5 * slope * shift
    part = N_CHROMA * np.log2(pitch[height >= np.median(height)] / 27.5) % 1.0
    part[part >= 0.5] -= 1.0
    counts, edges = np.histogram(part, np.linspace(-0.5, 0.5, 101))
    return float(edges[counts.argmax()])


def chroma(power: np.ndarray, size: int) -> np.ndarray:
    raw = power @ chroma_bank(size, tuning_of(power, size)).T
    top = raw.max(axis=1, keepdims=True)
    return np.divide(raw, top, out=np.zeros_like(raw), where=top > 0)


def lfcc(power: np.ndarray) -> np.ndarray:
    energy = power @ linear_bank(N_LINEAR, power.shape[1]).T
    return np.log(np.maximum(energy, FLOOR)) @ cosines(N_LINEAR, N_LFCC + 1)[1:].T


def slopes(series: np.ndarray, order: int) -> np.ndarray:
    """First or second derivative of a 9-frame polynomial fit per column; the four frames at either
    end take the derivative of the fit over the outermost nine."""
    k = np.arange(-4, 5)
    kernel = k / 60 if order == 1 else (3 * k**2 - 20) / 462
    windows = np.lib.stride_tricks.sliding_window_view(series, 9, axis=0)
    inner = windows @ kernel
    return np.pad(inner, ((4, 4), (0, 0)), mode="edge")
