"""End to end on generated tones: train, explain, predict in every variant, save and load."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipscore.functions import vectors as V
from clipscore.operators import models as Mo
from clipscore.operators import routing as R
from clipscore.plans import predict as P
from clipscore.plans.train import SPECTRAL, train
from tests.test_audio import RATE, wav


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Twelve two-second clips: a tone with little noise (real) or much (synthetic)."""
    root = tmp_path_factory.mktemp("corpus")
    rng = np.random.default_rng(1)
    lines = ["filename,label,group"]
    t = np.arange(2 * RATE) / RATE
    for i in range(12):
        noise = 0.01 if i < 6 else 0.25
        x = 0.5 * np.sin(2 * np.pi * (170 + 13 * i) * t) + noise * rng.normal(size=len(t))
        (root / f"clip{i:02d}.wav").write_bytes(wav(np.clip(x, -1, 1)))
        lines.append(f"clip{i:02d}.wav,{'real' if i < 6 else 'fake'},{'r' if i < 6 else 's'}{i}")
    meta = tmp_path_factory.mktemp("meta")
    (meta / "m.csv").write_text("\n".join(lines) + "\n")
    report = []
    return root, meta, report


@pytest.fixture(scope="module")
def trained(spark, corpus, tmp_path_factory):
    root, meta, _ = corpus
    out = tmp_path_factory.mktemp("model")
    report = train(
        spark, str(meta / "m.csv"), str(root), str(out / "run"), test_size=0.3, trees=12, depth=4,
        feature_store=str(out / "store"),
    ).first()
    return Mo.Blend.load(str(out / "run" / "model")), report, out


def scores(spark, path):
    rows = spark.read.csv(str(path), sep="\t", header=True).collect()
    return {r["filename"]: float(r["cm-score"]) for r in rows}


def test_report(trained):
    _, report, _ = trained
    assert report["samples"] == 12 and report["real"] == report["synthetic"] == 6
    assert report["holdout"]["test_samples"] == report["holdout"]["consistent"] >= 4
    assert 0 <= report["roc_auc"] <= 1 and report["method"] == "group holdout"


def test_predict_with_template_and_explanations(spark, corpus, trained, tmp_path):
    root, meta, _ = corpus
    model, _, _ = trained
    names = [f"clip{i:02d}.wav" for i in range(12)]
    order = names[::-1]
    (meta / "t.csv").write_text("filename\tcm-score\n" + "".join(f"{n}\t0\n" for n in order))
    out = P.predict(spark, model, str(root), str(tmp_path / "p"), str(meta / "t.csv"), str(tmp_path / "e"))
    assert [r["filename"] for r in out.orderBy("ord").collect()] == order
    got = scores(spark, tmp_path / "p")
    assert set(got) == set(names) and all(0 <= s <= 1 for s in got.values())
    lines = [json.loads(x) for f in (tmp_path / "e").glob("part-*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 12
    for e in lines:
        assert e["baseline_probability"] + e["total_contribution"] == pytest.approx(e["audio_score"])
        assert e["cm-score"] == pytest.approx(0.95 * e["audio_score"])
        assert e["cm-score"] == pytest.approx(got[e["filename"]], abs=1e-6)
        assert e["metadata"]["status"] == "consistent" and len(e["feature_evidence"]) <= 8
    (meta / "bad.csv").write_text("filename\nclip00.wav\n")
    with pytest.raises(ValueError, match="differ"):
        P.predict(spark, model, str(root), str(tmp_path / "q"), str(meta / "bad.csv"))


def test_predict_variants(spark, corpus, trained, tmp_path):
    root, meta, _ = corpus
    model, _, _ = trained
    files = P.inputs(spark, str(root), None)
    rows, _ = P.clip_rows(spark, str(root), files, ("base", "lfcc", "temporal", "quality"))
    label = (F.substring("filename", 5, 2).cast("int") >= 6).cast("int")
    rows = rows.withColumn("label", label).persist()
    wide = rows.withColumn("v", F.concat("base", "lfcc").cast("array<double>"))
    lfcc = Mo.fit(wide, Mo.Spec("logistic", c=0.1, iterations=10))
    P.predict_lfcc(spark, lfcc, str(root), str(tmp_path / "l"), lowpass_hz=7_000.0, real_weight=0.05)
    got = scores(spark, tmp_path / "l")
    assert np.mean([got[f"clip{i:02d}.wav"] for i in range(6, 12)]) > np.mean([got[f"clip{i:02d}.wav"] for i in range(6)])

    shape = rows.withColumn("temporal", F.col("temporal").cast("array<double>"))
    temporal = Mo.fit(shape, Mo.Spec("temporal", view="temporal", c=0.1, iterations=10))
    (meta / "policy.json").write_text(json.dumps({"temporal_weight": 1.0, "metadata_real_weight": 0.05}))
    P.predict_fused(spark, model, temporal, str(meta / "policy.json"), str(root), str(tmp_path / "f"))
    alone = {r["filename"]: r["score"] for r in temporal.score(shape).collect()}
    assert scores(spark, tmp_path / "f") == pytest.approx(alone, abs=1e-6)

    base = {r["filename"]: r["s"] for r in model.score(rows.withColumn("v", F.col("base").cast("array<double>")), "s").collect()}
    P.predict_routed(spark, model, str(root), str(tmp_path / "r0"))
    assert scores(spark, tmp_path / "r0") == pytest.approx(base, abs=1e-6)
    (meta / "second.tsv").write_text("filename\tsecond-score\n" + "".join(f"clip{i:02d}.wav\t0.5\n" for i in range(12)))
    P.predict_routed(spark, model, str(root), str(tmp_path / "r1"), str(meta / "second.tsv"))
    assert scores(spark, tmp_path / "r1") == pytest.approx({k: 0.5 * v + 0.25 for k, v in base.items()}, abs=1e-6)

    fit_rows = rows.withColumn("a", F.lit(0.2) + 0.5 * F.col("label")).withColumn("b", F.lit(0.5))
    router = Mo.fit_condition_router(fit_rows, "quality", "a", "b", clusters=2, min_size=4, restarts=2)
    assert 0 <= router.overall <= 1
    P.predict_routed(spark, model, str(root), str(tmp_path / "r2"), str(meta / "second.tsv"), router)
    assert all(0 <= s <= 1 for s in scores(spark, tmp_path / "r2").values())
    rows.unpersist()


def test_bad_clip_fails_or_is_set_aside(spark, corpus, tmp_path):
    root, _, _ = corpus
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes((root / "clip00.wav").read_bytes())
    (tmp_path / "in" / "b.wav").write_bytes(b"RIFF....WAVE")
    listed = P.inputs(spark, str(tmp_path / "in"), None)
    with pytest.raises(ValueError):
        P.clip_rows(spark, str(tmp_path / "in"), listed, ("base",))
    good, rejects = P.clip_rows(spark, str(tmp_path / "in"), listed, ("base",), mode="quarantine")
    assert [r["filename"] for r in good.collect()] == ["a.wav"]
    assert [r["clip_id"] for r in rejects.collect()] == ["b.wav"]


def test_absent_audio_is_an_error(spark, corpus, tmp_path):
    root, meta, _ = corpus
    (meta / "short.csv").write_text((meta / "m.csv").read_text() + "nowhere.wav,real,r99\n")
    with pytest.raises(ValueError, match="missing audio"):
        train(spark, str(meta / "short.csv"), str(root), str(tmp_path / "run"), feature_store=str(tmp_path / "store"))


def test_paths_are_names_not_patterns(spark, corpus, tmp_path):
    from clipscore.plans.train import contents, listing

    root, _, _ = corpus
    (tmp_path / "sub").mkdir()
    for name in ("a[1].wav", "a1.wav", "sub/b.wav"):
        (tmp_path / name).write_bytes((root / "clip00.wav").read_bytes())
    files = listing(spark, str(tmp_path))
    assert {r["filename"] for r in files.collect()} == {"a[1].wav", "a1.wav", "sub/b.wav"}
    wanted = files.where(F.col("filename").contains("["))
    assert [r["path"].rsplit("/", 1)[-1] for r in contents(spark, str(tmp_path), wanted).collect()] == ["a[1].wav"]
    assert contents(spark, str(tmp_path), wanted.where(F.lit(False))).count() == 0


def test_rejects_are_written_and_templates_are_complete(spark, corpus, trained, tmp_path):
    root, meta, _ = corpus
    model, _, _ = trained
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes((root / "clip00.wav").read_bytes())
    (tmp_path / "in" / "b.wav").write_bytes(b"RIFF....WAVE")
    P.predict(spark, model, str(tmp_path / "in"), str(tmp_path / "p"), mode="quarantine")
    assert set(scores(spark, tmp_path / "p")) == {"a.wav"}
    assert [r["clip_id"] for r in spark.read.json(str(tmp_path / "p_rejects")).collect()] == ["b.wav"]
    (meta / "both.csv").write_text("filename\na.wav\nb.wav\n")
    with pytest.raises(ValueError, match="without a score"):
        P.predict(spark, model, str(tmp_path / "in"), str(tmp_path / "q"), str(meta / "both.csv"), mode="quarantine")


def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 2, f"g{i % 8}", (rng.normal(size=6) + (i % 2)).tolist()) for i in range(160)]
    return spark.createDataFrame(rows, "clip_id int, label int, grp string, v array<double>")


def test_blend_and_kernel_machine(spark, tmp_path):
    data = vectors(spark).persist()
    specs = [(Mo.Spec("rbf_svm", "svm", random_features=64, iterations=10), 0.75), (Mo.Spec("logistic", c=0.1, iterations=10), 0.25)]
    model = Mo.fit_blend(data, specs)
    model.save(str(tmp_path / "m"))
    back = Mo.Blend.load(str(tmp_path / "m"))
    a = {r["clip_id"]: r["score"] for r in model.score(data).collect()}
    parts = back.components(back.score(data)).collect()
    assert {r["clip_id"]: r["score"] for r in parts} == pytest.approx(a)
    for r in parts:
        assert 0 <= r["rbf_svm"] <= 1
        assert r["score"] == pytest.approx(0.75 * r["rbf_svm"] + 0.25 * r["logistic"])
    shown = R.explain_blend(back.components(data).withColumn("status", F.lit("consistent")), {"rbf_svm": 0.75, "logistic": 0.25})
    for r in shown.collect():
        assert r["score"] == pytest.approx(0.95 * r["audio_score"])
        assert r["audio_score"] == pytest.approx(a[r["clip_id"]])


def test_random_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>")
    z = np.stack(df.select("i", Mo.random_fourier(F.col("v"), 5, 4096, 1).alias("z")).toPandas().sort_values("i")["z"])
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 5)
    assert np.abs(z @ z.T - want).max() < 0.1


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([([1.0, 7.0],), ([2.0, 7.0],), ([3.0, 7.0],), ([4.0, 7.0],)], "v array<double>")
    row = R.scaler(df, "v").first()
    assert row["mean"] == pytest.approx([2.5, 7.0]) and row["scale"] == pytest.approx([1.118033988749895, 1.0])


def test_out_of_fold_is_complete(spark):
    data = vectors(spark)
    folds = spark.createDataFrame([(f"g{i}", i % 2) for i in range(8)], "grp string, fold int")
    oof = Mo.out_of_fold(data, folds, 2, {"logistic": lambda d: Mo.fit(d, Mo.Spec("l", iterations=5))})
    assert oof.count() == 160 and oof.select("clip_id").distinct().count() == 160


def test_router_falls_back_for_small_and_one_class_clusters(spark):
    rows = [(0, i % 2, 0.9 * (i % 2), 0.5) for i in range(60)]
    rows += [(1, i % 2, 0.5, 0.9 * (i % 2)) for i in range(10)] + [(2, 1, 0.3, 0.9) for _ in range(50)]
    df = spark.createDataFrame(rows, "cluster int, label int, a double, b double")
    got = {r["cluster"]: r for r in R.cluster_alphas(df, "cluster", "a", "b").collect()}
    assert [got[c]["own"] for c in range(3)] == [True, False, False]
    assert got[1]["alpha"] == got[2]["alpha"] == got[0]["overall"]


def test_view_widths():
    assert {k: len(v) for k, v in V.VIEWS.items()} == {"base": 84, "lfcc": 120, "temporal": 136, "encoding": 14, "quality": 12}
    assert len(SPECTRAL) == 20
