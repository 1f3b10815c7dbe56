"""How fits and scores are dealt to tasks: the files of the tables are one partition each."""

from __future__ import annotations

import threading
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from clipscore.catalog import models as C
from clipscore.operators import models as Mo
from clipscore.operators import penalty
from clipscore.operators.joins import class_weights
from clipscore.operators.machines import machine_scores
from clipscore.plans.train import holdout_report
from tests.test_models import clips


class Seen:
    """In place of an estimator: the partitions and columns that it is given."""

    def __init__(self):
        self.parts = []

    def fit(self, train):
        assert train.columns == ["_x", "label", "_w"]
        self.parts.append(train.rdd.getNumPartitions())
        return self


def dealt(df, spec, monkeypatch) -> list[int]:
    seen = Seen()
    monkeypatch.setattr(Mo, "_estimator", lambda *_: seen)
    Mo.fit(df, spec, calibrate=False)
    return seen.parts


@pytest.mark.parametrize("least, most, parts", [(32_768, 65_536, 1), (40, 65_536, 4), (1, 65_536, 8), (1, 10, 16)])
def test_linear_fits_have_tasks_by_their_rows(spark, monkeypatch, least, most, parts):
    _, df = clips(spark)
    monkeypatch.setattr(Mo, "_LEAST_ROWS", least)
    monkeypatch.setattr(Mo, "_MOST_ROWS", most)
    assert dealt(df, Mo.Spec("svm", "svm", random_features=8), monkeypatch) == [parts]


@pytest.mark.parametrize("family", ["forest", "trees"])
def test_forests_are_fitted_on_all_cores(spark, monkeypatch, family):
    _, df = clips(spark)
    assert dealt(df.coalesce(1), Mo.Spec("forest", family, trees=2), monkeypatch) == [spark.sparkContext.defaultParallelism]
    monkeypatch.undo()
    assert Mo._estimator(Mo.Spec("forest", family), 1.0).getCacheNodeIds()


def test_ten_models_fit_two_at_a_time(spark, monkeypatch):
    """Each machine keeps the random features of its four fits, so few fits stand beside each other."""
    lock, now, most = threading.Lock(), [0], [0]

    class Half:
        def __init__(self, spec):
            self.spec = spec

        def score(self, df):
            return df.withColumn("score", F.lit(0.5))

    def fit(df, spec):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.2)
        with lock:
            now[0] -= 1
        return Half(spec)

    monkeypatch.setattr(Mo, "fit", fit)
    out = C.k9_ten_models(spark, "/root/testdata/sf0.001").collect()
    assert {r.model for r in out} == {s.name for s in Mo.COMPARISON} and most[0] == 2


def test_holdout_report_scores_a_clip_once(spark):
    _, df = clips(spark)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        calls.add(1)
        return i % 7 / 7

    data = df.withColumn("status", F.lit("consistent"))
    report = holdout_report(data.withColumn("score", score("clip_id")), data).first()
    assert report.samples == report.holdout.test_samples == calls.value == 160


def test_shared_vectors_are_dealt_to_all_cores(spark):
    train, test = C.sides(spark, "/root/testdata/sf0.001")
    assert train.rdd.getNumPartitions() == test.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_large_forest_is_grown_in_parts(spark, monkeypatch, tmp_path):
    """No fit grows more nodes than the bound; scores, importance, paths and files are those of all trees."""
    _, df = clips(spark)
    spec = Mo.Spec("forest", "forest", trees=7, depth=3, columns=(0, 1, 3))
    assert [(s.trees, s.seed) for s in Mo._planted(spec, 160)] == [(7, 42)]
    monkeypatch.setattr(Mo, "_MOST_NODES", 3 * 2**4)
    model = Mo.fit(df, spec)
    assert [m.getNumTrees for m in model.forests] == [3, 2, 2]
    data = df.persist()
    want = dict.fromkeys([r.clip_id for r in data.collect()], 0.0)
    for m in model.forests:
        whole = RandomForestClassificationModel.load(m.path)
        for r in whole.transform(model.inputs(data)).collect():
            want[r.clip_id] += r.probability[1] * m.getNumTrees / 7
    scored = model.score(data)
    got = {r.clip_id: r.score for r in scored.collect()}
    assert got == pytest.approx(want, abs=1e-12) and len(set(got.values())) > 20
    out = Mo.path_contributions(scored, Mo.Blend([(model, 1.0)]), 4).collect()
    assert len(out) == 160 and all(r.baseline + sum(r.contributions) == pytest.approx(got[r.clip_id], abs=1e-9) for r in out)
    assert sum(r.importance for r in Mo.importance(Mo.Blend([(model, 1.0)]), ("a", "b", "c", "d")).collect()) == pytest.approx(1)
    model.save(f"file://{tmp_path}/forest")
    again = {r.clip_id: r.score for r in Mo.Fitted.load(f"file://{tmp_path}/forest").score(data).collect()}
    assert again == got


@pytest.mark.parametrize("family", ["forest", "trees"])
def test_tasks_that_score_get_no_model_in_their_closure(spark, family):
    """A closure is read anew by every task, so its forest would stand in memory once a task."""
    _, df = clips(spark)
    model = Mo.fit(df, Mo.Spec("forest", family, trees=5, depth=4))
    scored = model.score(df)
    assert scored.columns == [*df.columns, "score"]
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "UDF(" not in plan
    want = {r.clip_id: r.probability[1] for r in model.model.transform(model.inputs(df)).collect()}
    assert {r.clip_id: r.score for r in scored.collect()} == pytest.approx(want, abs=1e-12)
    assert model.score(df.where("clip_id < 0")).count() == 0


def test_compared_machines_share_their_passes(spark, monkeypatch):
    """Six machines with their calibration parts start in one pass, and a machine scores as one that is fitted alone."""
    _, df = clips(spark)
    df = df.withColumn("base_lfcc", F.col("v"))
    specs = [replace(s, random_features=8, iterations=15) for s in Mo.COMPARISON if s.family == "svm"]
    train, test = df.where("clip_id % 4 <> 0"), df.where("clip_id % 4 = 0")
    want = {r.clip_id: r.score for r in Mo.fit(train, specs[0]).score(test).collect()}
    passes, losses = [], penalty._losses

    def counted(rows, columns, static, points):
        passes.append(len(points))
        return losses(rows, columns, static, points)

    monkeypatch.setattr(penalty, "_losses", counted)
    monkeypatch.setattr(Mo, "_estimator", None)
    got = {(r.model, r.clip_id): r.score for r in machine_scores(train, test, specs).collect()}
    assert passes[0] == len(specs) * 4 and len(passes) < 6 * 15
    assert set(got) == {(s.name, i) for s in specs for i in want}
    assert max(abs(got[specs[0].name, i] - v) for i, v in want.items()) < 0.1
    with pytest.raises(ValueError, match="alone"):
        machine_scores(train, test, [specs[0], replace(specs[1], seed=1)])


def test_compared_machines_lower_the_hinge_of_a_fit_alone(spark):
    rows, df = clips(spark)
    weighting = "cost"  # whose walks meet more corners
    spec = Mo.Spec("svm", "svm", c=1.0, weighting=weighting, random_features=24)
    model = Mo.fit(df, spec, calibrate=False)
    keyed = df.withColumn("keys", F.array(F.lit(0)))
    made = penalty.keyed_machines(keyed, "v", "keys", "label", [(0.3, "balanced"), (1.0, weighting)], [0.0, 1.0], spec, 1e-6)
    x, y = np.array([v for *_, v in rows]), np.array([label for _, label, *_ in rows])
    basis = Mo.fourier_basis(4, 24, spec.seed)
    z = np.sqrt(2 / 24) * np.cos((x - x.mean(0)) / x.std(0) @ basis[0] + basis[1])
    weight = np.where(y == 1, *reversed(class_weights(weighting, int((y == 0).sum()), int(y.sum()))))

    def objective(w, b):
        hinge = np.maximum(0, 1 - (2 * y - 1) * (z @ w + b))
        return (weight * hinge).sum() / weight.sum() + w @ w / (2 * weight.sum())

    own = made.solutions[0][1]
    assert objective(own[:-1], own[-1]) <= 1.001 * objective(model.model.coefficients.toArray(), model.model.intercept)
    got = {r.clip_id: r.margin for r in made.margins(keyed, "v", "keys", "clip_id", "label").collect() if r.c == 1.0}
    assert np.allclose([got[i] for i, *_ in rows], z @ own[:-1] + own[-1])


def test_machines_of_one_clip_of_a_class_are_an_error(spark):
    _, df = clips(spark)
    df = df.withColumn("base_lfcc", F.col("v"))
    one = df.where("label = 0 OR clip_id = 1")
    assert one.where("label = 1").count() == 1
    with pytest.raises(ValueError, match="both classes"):
        machine_scores(one, df, [s for s in Mo.COMPARISON if s.family == "svm"])
