"""Decoding, spectra, feature assembly and container rules on generated bytes."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipscore.functions import audio as A
from clipscore.functions import containers as C
from clipscore.functions import spectral as Sp
from clipscore.functions import vectors as V
from clipscore.operators import clip_features as CF
from clipscore.operators import frames as Fr
from clipscore.sources import listing

RATE = 16_000


def wav(samples, rate=RATE, bits=16, channels=1, code=1, extra=b"", riff=None):
    if code == 3:
        body = np.asarray(samples, "<f4").tobytes()
    elif bits == 8:
        body = np.clip(np.rint(np.asarray(samples) * 128 + 128), 0, 255).astype(np.uint8).tobytes()
    elif bits == 24:
        q = np.rint(np.asarray(samples) * (2**23 - 1)).astype("<i4")
        body = q.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        body = np.rint(np.asarray(samples) * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    align = channels * bits // 8
    fmt = struct.pack("<HHIIHH", code, channels, rate, rate * align, align, bits)
    chunks = b"fmt " + struct.pack("<I", 16) + fmt + extra + b"data" + struct.pack("<I", len(body)) + body
    chunks += b"\0" * (len(body) % 2)
    size = len(chunks) + 4 if riff is None else riff
    return b"RIFF" + struct.pack("<I", size) + b"WAVE" + chunks


def tone(hz, seconds=2.0, level=0.5, rate=RATE):
    return level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


@pytest.mark.parametrize("bits, code", [(8, 1), (16, 1), (24, 1), (32, 1), (32, 3)])
def test_decode_depths(bits, code):
    x = tone(440)
    got = A.decode(wav(x, bits=bits, code=code))
    assert len(got) == len(x)
    assert np.abs(got - x).max() < (0.02 if bits == 8 else 1e-3)


def test_decode_channels_rates_and_length():
    x = tone(440, rate=8_000)
    stereo = np.stack((x, np.zeros_like(x)), axis=1).ravel()
    got = A.decode(wav(stereo, rate=8_000, channels=2))
    assert len(got) == 2 * len(x)
    assert np.abs(got[500:-500] - tone(440, level=0.25)[500:-500]).max() < 1e-3
    assert len(A.decode(wav(np.zeros(RATE * 121)))) == RATE * 121
    assert len(A.decode(wav(np.zeros(RATE * 3)), seconds=2)) == RATE * 2
    for bad in (b"OggS" + bytes(60), wav(tone(1))[:20]):
        with pytest.raises(ValueError):
            A.decode(bad)


def test_admission_rules():
    assert A.rejection(tone(440, 0.4)) and A.rejection(np.zeros(RATE))
    assert A.rejection(np.full(RATE, np.nan))
    assert A.rejection(tone(440)) is None


def test_tone_lands_in_its_bin_class_and_band():
    mag = A.magnitudes(tone(440), 1024, 256)
    assert mag.shape == (1 + 2 * RATE // 256, 513)
    assert abs(mag[20].argmax() * RATE / 1024 - 440) < RATE / 1024
    assert A.chroma(mag**2, 1024)[20].argmax() == 9  # pitch class A
    freqs = np.fft.rfftfreq(1024, 1 / RATE)
    assert A.band_shares(mag, freqs)[0][20] > 0.99
    assert A.crossings(tone(440), 1024, 256)[20] == pytest.approx(2 * 440 / RATE, rel=0.03)
    assert A.rms(mag, 1024)[40] == pytest.approx(0.5 * np.sqrt(np.mean((0.5 - 0.5 * np.cos(np.linspace(0, 2 * np.pi, 1024))) ** 2) / 2), rel=0.01)


def test_banks_and_transforms():
    bank = A.linear_bank(64, 513)
    assert bank.shape == (64, 513) and np.allclose(bank.sum(axis=1), 1)
    basis = A.cosines(64, 64)
    assert np.allclose(basis @ basis.T, np.eye(64))
    mel = A.mel_bank(1024)
    assert mel.shape == (128, 513) and (mel.sum(axis=1) > 0).all()
    assert (np.diff(mel.argmax(axis=1)) >= 0).all()


def test_lowpass_passes_and_stops():
    x = tone(1_000) + tone(7_000)
    y = A.lowpass(x, 4_000)
    assert np.abs(y[2000:-2000] - tone(1_000)[2000:-2000]).max() < 0.01
    for bad in (0, 8_000, 9_000):
        with pytest.raises(ValueError):
            A.lowpass(x, bad)


@pytest.mark.parametrize("order", [1, 2])
def test_slopes_equal_polynomial_fits(order):
    x = np.random.default_rng(3).normal(size=40)
    got = A.slopes(x[:, None], order)[:, 0]
    for t in range(40):
        c = min(max(t, 4), 35)
        fit = np.polyfit(np.arange(-4, 5), x[c - 4 : c + 5], order)
        assert got[t] == pytest.approx(fit[0] * (2 if order == 2 else 1))


def test_native_measures_equal_the_array_ones(spark):
    mag = A.magnitudes(tone(300) + np.random.default_rng(0).normal(0, 0.05, 2 * RATE), 126, 63)[5:15]
    freqs = np.arange(64) * 100.0
    rows = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(mag)], "i int, mag array<double>")
    m = F.col("mag")
    got = rows.orderBy("i").select(
        Sp.rms(m, 64).alias("rms"), Sp.centroid(m, 100.0).alias("c"), Sp.bandwidth(m, 100.0).alias("b"),
        Sp.rolloff(m, 100.0).alias("r"), Sp.flatness(m, 64).alias("f"), Sp.band_share(m, 100.0, 500, 2000).alias("mid"),
        Sp.dct(m, 64, 20).alias("dct"),
    ).toPandas()
    assert np.allclose(got["rms"], A.rms(mag, 126))
    assert np.allclose(got["c"], A.centroid(mag, freqs))
    assert np.allclose(got["b"], A.bandwidth(mag, freqs))
    assert np.allclose(got["r"], A.rolloff(mag, freqs))
    assert np.allclose(got["f"], A.flatness(mag))
    assert np.allclose(got["mid"], A.band_shares(mag, freqs)[1])
    assert np.allclose(np.stack(got["dct"]), mag @ A.cosines(64, 20).T)


def test_chunked_windows_equal_whole_windows(spark, monkeypatch):
    from clipscore.operators import ordered

    rows = spark.createDataFrame(
        [(c, i, 57, float(np.sin(i * (c + 1)))) for c in range(2) for i in range(57)],
        "clip_id int, frame_idx int, n_frames bigint, x double",
    )
    whole = sorted(map(tuple, Fr.derivatives(rows, "x").select("clip_id", "frame_idx", "delta", "delta2").collect()))
    monkeypatch.setattr(Fr, "chunked", lambda df, index, halo: ordered.chunked(df, index, halo, 20))
    cut = sorted(map(tuple, Fr.derivatives(rows, "x").select("clip_id", "frame_idx", "delta", "delta2").collect()))
    assert whole == cut and len(whole) == 114


def test_short_series_repeat_frames_over_windows(spark):
    rows = spark.createDataFrame([(1, i, 3, float(i)) for i in range(3)], "clip_id int, frame_idx int, n_frames bigint, x double")
    got = {r["win"]: (r["frames"], r["x_mean"]) for r in Fr.window_stats(rows, ["x"]).collect()}
    for b in range(8):
        start = b * 3 // 8
        part = list(range(start, max((b + 1) * 3 // 8, start + 1)))
        assert got[b] == (len(part), np.mean(part))


def clip_table(spark, named):
    rows = [(n, bytearray(b), len(b), ".wav") for n, b in named.items()]
    return spark.createDataFrame(rows, "clip_id string, content binary, length long, suffix string")


def test_all_views_from_one_pass(spark):
    rng = np.random.default_rng(0)
    low, high = tone(180), tone(2_800)
    named = {
        "low_high": wav(np.concatenate((low, high))),
        "high_low": wav(np.concatenate((high, low))),
        "noise": wav(np.clip(rng.normal(0, 0.1, RATE), -1, 1)),
        "short": wav(tone(440, 0.3)),
        "broken": b"RIFF" + bytes(50),
    }
    tags = spark.createDataFrame([("noise", "encoder", "Some TTS 2")], "clip_id string, key string, value string")
    good, rejects = CF.features(clip_table(spark, named), tags=tags)
    rows = {r["clip_id"]: r for r in good.collect()}
    assert set(rows) == {"low_high", "high_low", "noise"}
    assert {r["clip_id"] for r in rejects.collect()} == {"short", "broken"}
    for r in rows.values():
        for view, names in V.VIEWS.items():
            assert len(r[view]) == len(names) and np.isfinite(r[view]).all()
    a, b = rows["low_high"]["temporal"], rows["high_low"]["temporal"]
    assert a[10] > b[10] and np.abs(np.array(a) - np.array(b)).max() > 0.1
    assert rows["noise"]["encoding"][:5] == [1.0, 1.0, 1.0, 16000.0, 16.0]
    assert rows["noise"]["quality"][-2:] == [1.0, 1.0] and rows["low_high"]["quality"][-2:] == [0.0, 0.0]
    # The window moments merge to the plain mean and deviation over all frames.
    series = CF.series(A.decode(named["noise"]), ("base", "lfcc", "temporal"))
    for view in ("base", "lfcc"):
        want = np.column_stack((series[view].mean(axis=0), series[view].std(axis=0))).ravel()
        assert np.allclose(rows["noise"][view], want, rtol=1e-4, atol=1e-5)
    frames = np.array_split(np.arange(len(series["temporal"])), [len(series["temporal"]) * k // 8 for k in range(1, 8)])
    means = np.array([series["temporal"][f].mean(axis=0) for f in frames])
    slope = np.polyfit(np.linspace(-1, 1, 8), means, 1)[0]
    assert np.allclose(rows["noise"]["temporal"][-8:], slope, rtol=1e-4, atol=1e-6)
    with pytest.raises(ValueError):
        CF.features(clip_table(spark, named), ("base",), mode="fail")


def test_tasks_return_clips_in_batches_and_parts_of_a_view_alone(spark):
    rng = np.random.default_rng(3)
    named = {f"c{i:03d}": wav(rng.normal(size=9_000 if i % 3 else 100) * 0.1) for i in range(90)}
    clips = clip_table(spark, named).coalesce(1)
    out = CF.measure(clips, ("base", "mfcc", "chroma"))
    rows = {r["clip_id"]: r for r in out.collect()}
    assert [r["reason"] is None for _, r in sorted(rows.items())] == [i % 3 > 0 for i in range(90)]
    assert all((r["base"] is None) == (r["signal"] is None) == (r["reason"] is not None) for r in rows.values())
    good, _ = CF.features(clips, ("base", "mfcc", "chroma"))
    for r in good.collect():
        parts = {p: [x for n, x in zip(V.BASE, r["base"]) if n in V.PARTS[p]] for p in V.PARTS}
        assert len(r["mfcc"]) == 40 and len(r["chroma"]) == 24 and all(r[p] == parts[p] for p in parts)


def test_shared_frames_and_grouped_logarithms_are_exact():
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=9_001), np.concatenate((np.zeros(9_000), rng.normal(size=900) * 1e-3)), rng.normal(size=8_000) * 1e30):
        alone, shared = CF.reduced(x, (), True)["signal"], CF.reduced(x, ("base",), True)["signal"]
        for k, v in alone.items():
            assert np.allclose(shared[k], v, rtol=1e-9)
        power = np.maximum(A.magnitudes(x, 1024, 512) ** 2, A.FLOOR)
        assert np.allclose(A.flatness(np.sqrt(power)), np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1), rtol=1e-12)
        signs = A.framed(np.where(np.abs(x) <= A.FLOOR, 0.0, x), 1024, 256, "edge") < 0
        assert np.array_equal(A.crossings(x, 1024, 256), (signs[:, 1:] != signs[:, :-1]).sum(axis=1) / 1024)


def status(spark, named):
    rows = [(n, bytearray(b), len(b), n[n.rindex(".") :]) for n, b in named.items()]
    df = spark.createDataFrame(rows, "clip_id string, content binary, length long, suffix string")
    return {r["clip_id"]: r["container"]["status"] for r in C.with_verdict(df).collect()}


def test_container_rules(spark):
    good = wav(tone(440, 0.1))
    text = bytes(range(65, 91)) * 4
    flac = b"fLaC\0\0\0\x22" + bytes(10) + ((16000 << 44) | (0 << 41) | (15 << 36)).to_bytes(8, "big") + bytes(30)
    got = status(
        spark,
        {
            "a.wav": good,
            "tail.wav": good + b"xyz",
            "list.wav": wav(tone(440, 0.1), extra=b"LIST\x03\0\0\0abc\0"),
            "many.wav": wav(tone(440, 0.1), extra=b"junk\0\0\0\0" * 500),
            "size.wav": wav(tone(440, 0.1), riff=len(good) + 100),
            "small.wav": wav(tone(440, 0.1), riff=20),
            "name.wav": b"ID3\x04" + bytes(60),
            "rf64.wav": b"RF64" + good[4:],
            "chunk.wav": wav(tone(440, 0.1), extra=b"LIST\xff\xff\xff\x7f"),
            "odd.wav": wav(tone(440, 0.1), riff=len(good) - 6),
            "empty.wav": wav([]),
            "a.flac": flac,
            "rate.flac": flac[:18] + bytes(8) + flac[26:],
            "cut.flac": flac[:30],
            "a.mp3": b"ID3\x04\0\0\0\0\0\x0a" + text,
            "long.mp3": b"ID3\x04\0\0\0\0\x7f\x7f" + text,
            "sync.mp3": b"\xff\xfb\x90\0" + text,
            "none.mp3": text,
            "a.m4a": b"\0\0\0\x18ftypM4A " + text,
            "box.mp4": b"\x7f\xff\xff\xffftyp" + text,
            "a.ogg": b"OggS\0" + text,
            "a.opus": b"OggT\0" + text,
            "a.aiff": b"FORM\0\0\0\0AIFF" + text,
            "c.aif": b"FORM\0\0\0\0AIFX" + text,
            "a.webm": bytes.fromhex("1a45dfa3") + text,
            "a.wma": bytes.fromhex(C.ASF) + text,
            "a.aac": b"\xff\xf1" + text,
            "b.aac": b"\xff\xe1" + text,
            "a.txt": text,
        },
    )
    fine = {"a.wav", "tail.wav", "list.wav", "many.wav", "a.flac", "a.mp3", "sync.mp3", "a.m4a", "a.ogg",
            "a.aiff", "a.webm", "a.wma", "a.aac"}
    assert {k for k, v in got.items() if v == "consistent"} == fine
    assert {k for k, v in got.items() if v == "unknown"} == {"rf64.wav", "a.txt"}


def test_wav_facts(spark):
    good = wav(tone(440, 3))
    named = {"a": good, "b": b"RIFX" + bytes(60)}
    rows = {r["clip_id"]: r["header"] for r in C.with_wav_facts(clip_table(spark, named)).collect()}
    assert rows["a"][:6] == [1, 1, 1, 16000, 16, 32000]
    assert rows["a"][6] == pytest.approx(np.log1p(len(good) / 3))
    assert rows["b"] == [1, 0, 0, 0, 0, 0, pytest.approx(np.log1p(64))]


def test_member_rules(spark):
    names = [("resampled/LJ001-0001.wav", 10), ("resampled/LJ1.wav", 10), ("a/../LJ001-0001.wav", 10),
             ("/resampled/LJ001-0001.wav", 10), ("resampled/LJ001-0002.wav", 30_000_001),
             ("resampled/LJ001 0001.wav", 1)]
    df = spark.createDataFrame(names, "member string, size long")
    out = {r["member"]: r["status"] for r in listing.check_members(df, (2,), listing.REAL_MEMBER, max_bytes=30_000_000).collect()}
    assert list(out.values()) == ["accepted", "ignored", "unsafe path", "unsafe path", "too large", "unsafe path"]


def test_lowpass_transforms_smooth_lengths(monkeypatch):
    """A prime length costs no more than its neighbours, and the result is that of the plain transform."""
    x = np.random.default_rng(3).normal(size=20_011)
    lengths, plain = [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda y, *a, **k: (lengths.append(len(y)), plain(y, *a, **k))[1])
    got = A.lowpass(x, 4_000.0)
    rest = lengths[0]
    for p in (2, 3, 5):
        while rest % p == 0:
            rest //= p
    assert rest == 1
    y = np.concatenate((2 * x[0] - x[4096:0:-1], x, 2 * x[-1] - x[-2:-4098:-1]))
    f = np.fft.rfftfreq(len(y), 1 / A.RATE)
    ratio = np.tan(np.pi * np.minimum(f, A.RATE / 2 - 1e-9) / A.RATE)
    want = np.fft.irfft(plain(y) / (1 + ratio**12), len(y))[4096 : 4096 + len(x)]
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_clips_are_rendered_once(spark):
    """Both bands and both outcomes of a clip come from one read of the documents."""
    from clipscore import views
    from clipscore.catalog import all_queries

    sf = "/root/testdata/sf0.001"
    out = all_queries()["d3_common_band"](spark, sf)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    each = [CF.measure(views.clips(spark, sf), (), True, c).where("reason IS NULL").select("clip_id", CF.fact("high").alias("v")) for c in (None, 4000.0)]
    raw, low = ({r.clip_id: r.v for r in df.collect()} for df in each)
    assert tuple(out.first()) == pytest.approx((len(raw), np.mean(list(raw.values())), np.mean(list(low.values()))), rel=1e-9)
    scored = all_queries()["k13_batch_scores"](spark, sf)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert all((r["cm-score"] is None) == (r["reason"] is not None) for r in scored.collect())
