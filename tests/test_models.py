"""Path explanations, penalty paths and nested training sets against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clipscore.operators import models as Mo
from clipscore.operators import penalty
from clipscore.plans import tuning

WIDTH = 4


def clips(spark, n=160, groups=16, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = (i // 2 + i) % 2
        rows.append((i, label, f"g{i % groups}", [rng.gauss(label * (j == 1), 1.0) for j in range(WIDTH)]))
    return rows, spark.createDataFrame(rows, "clip_id bigint, label int, grp string, v array<double>").repartition(5)


def test_path_contributions_equal_a_plain_walk(spark):
    rows, df = clips(spark)
    forest = Mo.Spec("forest", "forest", trees=7, depth=3)
    blend = Mo.fit_blend(df, [(forest, 0.5), (Mo.Spec("part", "trees", trees=5, depth=4, columns=(1, 3)), 0.5)])
    unseen = df.select("clip_id", "label", "v", F.lit("kept").alias("feature"))
    out = {r.clip_id: r for r in Mo.path_contributions(blend.score(unseen), blend, WIDTH).collect()}
    assert len(out) == len(rows) and all(r.feature == "kept" for r in out.values())
    base, want = 0.0, {i: np.zeros(WIDTH) for i in out}
    for model, weight in blend.parts:
        nodes = {(r.tree, r.id): r for r in Mo._nodes(model.model, Mo.shared_path(spark)).collect()}
        trees = {t for t, _ in nodes}
        columns = model.spec.columns or range(WIDTH)
        cuts = spark.read.parquet(_saved(spark, model)).select("treeID", "nodeData.id", F.get("nodeData.split.leftCategoriesOrThreshold", 0).alias("cut"))
        cuts = {(r.treeID, r.id): r.cut for r in cuts.collect()}
        base += sum(weight / len(trees) * nodes[t, 0].p for t in trees)
        for i, _, _, v in rows:
            for t in trees:
                at = nodes[t, 0]
                while at.left >= 0:
                    child = nodes[t, at.left if v[columns[at.feature]] <= cuts[t, at.id] else at.right]
                    want[i][columns[at.feature]] += weight / len(trees) * (child.p - at.p)
                    at = child
    for i, r in out.items():
        assert r.contributions == pytest.approx(want[i], abs=1e-9) and r.baseline == pytest.approx(base)
        assert r.baseline + sum(r.contributions) == pytest.approx(r.score, abs=1e-9)


def _saved(spark, model):
    path = Mo.shared_path(spark)
    model.model.write().overwrite().save(path)
    return f"{path}/data"


def test_path_contributions_of_no_clips(spark):
    _, df = clips(spark)
    blend = Mo.fit_blend(df, [(Mo.Spec("forest", "forest", trees=3, depth=2), 1.0)])
    assert Mo.path_contributions(df.where("clip_id < 0"), blend, WIDTH).count() == 0


def objective(z, y, weight, c, w):
    """Mean rounded hinge plus the penalty of one set, and its gradient."""
    sign, e = 2.0 * y - 1.0, penalty.ROUNDING
    gap = 1 - sign * (z @ w[:-1] + w[-1])
    loss = np.where(gap <= 0, 0, np.where(gap < e, gap**2 / (2 * e), gap - e / 2))
    slope = np.where(gap <= 0, 0, np.where(gap < e, gap / e, 1.0)) * -sign * weight
    g = np.append(z.T @ slope, slope.sum()) / len(y)
    g[:-1] += w[:-1] / (c * len(y))
    return (weight * loss).sum() / len(y) + (w[:-1] @ w[:-1]) / (2 * c * len(y)), g


def test_penalty_paths_reach_the_optimum_of_each_set(spark):
    rows, df = clips(spark)
    spec = Mo.Spec("svm", "svm", random_features=24)
    sets = {7: lambda i: i % 3 != 0, 8: lambda i: i % 4 != 1}
    of = {i: [k for k, f in sets.items() if f(i)] for i, *_ in rows}
    keyed = spark.createDataFrame(list(of.items()), "clip_id bigint, keys array<int>")
    placed = df.join(keyed, "clip_id")
    cs = (0.3, 3.0)
    paths = penalty.keyed_paths(placed, "v", "keys", "label", cs, spec, tolerance=1e-9)
    got = {(r.clip_id, r.key, r.c): r.margin for r in paths.margins(placed, "v", "keys", "clip_id", "label").collect()}
    assert len(got) == len(cs) * sum(map(len, of.values()))
    basis = Mo.fourier_basis(WIDTH, 24, spec.seed)
    for k, member in sets.items():
        x = np.array([v for i, _, _, v in rows if member(i)])
        y = np.array([label for i, label, *_ in rows if member(i)])
        z = np.sqrt(2 / 24) * np.cos((x - x.mean(0)) / x.std(0) @ basis[0] + basis[1])
        weight = len(y) / (2 * np.where(y == 1, y.sum(), len(y) - y.sum()))
        for j, c in enumerate(cs):
            w = np.zeros(25)
            best = objective(z, y, weight, c, w)[0]
            step = 0.5
            for _ in range(20_000):  # plain descent
                f, g = objective(z, y, weight, c, w)
                trial = w - step * g
                if objective(z, y, weight, c, trial)[0] > f:
                    step /= 2
                    continue
                w, best = trial, min(best, f)
            found = paths.solutions[k][j]
            assert objective(z, y, weight, c, found)[0] <= best * 1.001
            margins = [got[i, k, c] for i, *_ in rows if member(i)]
            assert np.allclose(margins, z @ found[:-1] + found[-1])


def test_penalties_of_a_set_share_passes(spark, monkeypatch):
    """More penalties take no more passes than the slowest alone, and rows are dealt to all cores however few bytes they are."""
    _, df = clips(spark)
    placed = df.withColumn("keys", F.array(F.lit(1), F.lit(2))).coalesce(1)
    spec, passes, losses = Mo.Spec("svm", "svm", random_features=24), [], penalty._losses

    def counted(rows, columns, static, points):
        passes.append(rows.rdd.getNumPartitions())
        return losses(rows, columns, static, points)

    monkeypatch.setattr(penalty, "_losses", counted)
    taken = []
    for cs in ((10.0,), (0.1, 0.3, 1.0, 3.0, 10.0)):
        passes.clear()
        penalty.keyed_paths(placed, "v", "keys", "label", cs, spec)
        taken.append(len(passes))
        assert set(passes) == {spark.sparkContext.defaultParallelism}
    assert taken[1] <= taken[0] + 2


def test_random_features_are_formed_in_blocks(monkeypatch):
    """Beside a batch and its features a task holds the angles of few rows."""
    inner, seen, cos = [], [], np.cos
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: (inner.append(f), lambda column: column)[1])
    Mo.random_fourier(None, 6, 16, 42)
    monkeypatch.setattr(np, "cos", lambda x, **k: (seen.append(len(x)), cos(x, **k))[1])
    x = np.random.default_rng(5).normal(size=(1_000, 6))
    w, b = Mo.fourier_basis(6, 16, 42)
    got = list(inner[0](iter([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array([], pa.list_(pa.float64()))])))
    assert max(seen) <= 256 and [len(g) for g in got] == [1_000, 0]
    assert np.allclose(got[0].to_pylist(), np.sqrt(2 / 16) * cos(x @ w + b))
    with pytest.raises(ValueError):
        list(inner[0](iter([pa.array([[1.0] * 6, None], pa.list_(pa.float64()))])))


def test_a_set_of_one_class_is_an_error(spark):
    _, df = clips(spark)
    one = df.withColumn("keys", F.array(F.lit(1), F.col("label") + 2))
    with pytest.raises(ValueError, match="both classes"):
        penalty.keyed_paths(one, "v", "keys", "label", (1.0,), Mo.Spec("svm", "svm", random_features=8))


def test_sigmoids_equal_plain_newton(spark):
    rng = random.Random(5)
    rows = [(k, int(rng.random() < 0.4), rng.gauss(0, 1 + k)) for k in (0, 1) for _ in range(200)]
    rows += [(2, y, 2.0 * y - 1) for y in (0, 1) for _ in range(10)]  # separable
    df = spark.createDataFrame(rows, "k int, label int, margin double")
    got = {r.k: (r.a, r.b) for r in penalty.keyed_sigmoids(df, ["k"]).collect()}
    for k in (0, 1, 2):
        y = np.array([r[1] for r in rows if r[0] == k])
        x = np.array([[r[2], 1.0] for r in rows if r[0] == k])
        n1, n0 = y.sum(), len(y) - y.sum()
        t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (p - t))
        assert got[k] == pytest.approx(tuple(w), abs=5e-3)


@pytest.mark.parametrize("inner", [3, 0])
def test_training_sets_keep_groups_and_parts_apart(spark, inner):
    rows, df = clips(spark)
    out = tuning.training_sets(df, 4, inner, 11).collect()
    assert len(out) == len(rows)
    decode = lambda c: (c // 10_000 - 1, c % 10_000 // 10 - 1, c % 10 - 1)
    trained, scored, groups = {}, {}, {}
    for r in out:
        assert len(set(r.trains)) == len(r.trains) and len(set(r.held)) == len(r.held)
        assert not set(r.trains) & set(r.held)
        for c in r.trains:
            trained.setdefault(decode(c), set()).add(r.clip_id)
            groups.setdefault(decode(c), set()).add(r.grp)
        for c in r.held:
            scored.setdefault(decode(c), []).append(r)
    sides = {-1: 4, **({o: 3 for o in range(4)} if inner else {})}
    want = {(o, i, p) for o, n in sides.items() for i in range(-1 if o >= 0 else 0, n) for p in range(-1, 3)}
    assert set(trained) == want == set(scored)
    side = {o: {r.clip_id for r in out if o == -1 or r._outer != o} for o in sides}
    for (o, i, p), members in trained.items():
        held = {r.clip_id for r in scored[o, i, p]}
        if p == -1:  # whole groups are left out
            assert not groups[o, i, p] & {r.grp for r in scored[o, i, p]}
            assert held == (side[o] - members if i >= 0 else {r.clip_id for r in out if r._outer == o})
        else:  # a part of the set without parts
            assert members | held == trained[o, i, -1] and not members & held
    for o, n in sides.items():  # every row of a side is scored once out of fold
        assert sorted(r.clip_id for i in range(n) for r in scored[o, i, -1]) == sorted(side[o])


def test_smaller_penalties_win_ties(spark):
    rows = [(0, i, c, y, float(y)) for i in (0, 1) for c in (3.0, 1.0) for y in (0, 1)]
    rows += [(0, -1, 0.1, y, float(y)) for y in (0, 1)]  # scores of an outer fold choose nothing
    df = spark.createDataFrame(rows, "outer int, inner int, c double, label int, score double")
    assert [(r.outer, r.c, r.inner_min_dcf) for r in tuning.choose_penalties(df).collect()] == [(0, 1.0, 0.0)]
