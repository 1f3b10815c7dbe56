"""Metric goldens and agreement of the split and plain ordered plans."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipscore.operators import comparison, grouping
from clipscore.operators import metrics as M

SIX = ([0, 0, 0, 1, 1, 1], [0.1, 0.4, 0.6, 0.2, 0.7, 0.9])


def table(spark, labels, scores, **keys):
    rows = [(*keys.values(), int(y), float(s)) for y, s in zip(labels, scores)]
    return spark.createDataFrame(rows, [*keys, "label", "score"])


@pytest.mark.parametrize(
    "labels, scores, costs, want, threshold",
    [
        ([1, 0, 1, 0, 0], [0.75, 0.3, 0.65, 0.05, 0.25], M.DEFAULT, 0.0, 0.65),
        ([0] * 20 + [1] * 8, [0.15] * 19 + [0.95] + [0.85] * 8, M.DEFAULT, 2.8 * 0.05 / 0.3, 0.85),
        ([1, 0, 1, 0, 1], [0.35, 0.35, 0.55, 0.2, 0.55], M.DEFAULT, 1 / 3, 0.55),
        ([0, 1, 1], [0.25] * 3, M.DEFAULT, 1.0, math.nextafter(0.25, 1)),
        ([0, 1, 1], [0.25] * 3, M.Costs(0.4, 5.0, 1.0), 1.0, 0.25),
        (*SIX, M.DEFAULT, 1 / 3, 0.7),
    ],
)
def test_min_dcf_goldens(spark, labels, scores, costs, want, threshold):
    cost, t = M.min_dcf_value(table(spark, labels, scores), costs=costs)
    assert cost == pytest.approx(want)
    assert t == threshold


def test_min_dcf_is_scale_free(spark):
    doubled = M.Costs(0.3, 2.0, 8.0)
    rows = table(spark, *SIX)
    assert M.min_dcf_value(rows, costs=doubled) == pytest.approx(M.min_dcf_value(rows))


@pytest.mark.parametrize("bad", [(0.0, 1, 4), (1.0, 1, 4), (0.3, 0, 4), (0.3, 1, -1), (0.3, math.inf, 4)])
def test_costs_are_checked(bad):
    with pytest.raises(ValueError):
        M.Costs(*bad)


def test_undefined_inputs(spark):
    with pytest.raises(ValueError, match="both labels"):
        M.min_dcf_value(table(spark, [1, 1], [0.1, 0.2]))
    with pytest.raises(ValueError, match="finite"):
        M.min_dcf_value(table(spark, [0, 1], [0.1, math.nan]))
    row = M.min_dcf(table(spark, [1, 1], [0.1, 0.2]), []).first()
    assert row["min_dcf"] is None and row["reason"] == "one class only"


@pytest.mark.parametrize("cutoff, want", [(0.45, (0.3 * 0.25 + 2.8 * 0.5) / 0.3), (math.inf, 1.0), (-math.inf, 2.8 / 0.3)])
def test_dcf_at_cutoff(spark, cutoff, want):
    rows = table(spark, [0, 1, 1, 0, 1, 1], [0.15, 0.4, 0.45, 0.6, 0.65, 1.0])
    assert M.dcf_at(rows, [], cutoff).first()["dcf"] == pytest.approx(want)
    with pytest.raises(ValueError):
        M.dcf_at(rows, [], math.nan)


def brute(labels, scores):
    """Threshold loop over every candidate."""
    y, s = np.array(labels), np.array(scores)
    cuts = [*np.unique(s), np.nextafter(s.max(), np.inf)]
    rates = [((s[y == 0] >= t).mean(), (s[y == 1] < t).mean()) for t in cuts]
    costs = [(0.3 * miss + 2.8 * fa) / 0.3 for fa, miss in rates]
    k = int(np.argmin(costs))
    wins = sum((p > n) + 0.5 * (p == n) for p in s[y == 1] for n in s[y == 0])
    ap, before = 0.0, 0.0
    for t in np.unique(s)[::-1]:
        called = s >= t
        recall = (called & (y == 1)).sum() / (y == 1).sum()
        ap += (recall - before) * (called & (y == 1)).sum() / called.sum()
        before = recall
    return costs[k], cuts[k], rates[k][0], rates[k][1], wins / ((y == 1).sum() * (y == 0).sum()), ap


@pytest.mark.parametrize("ranges", [1, 7, 4096])
def test_summary_matches_brute_force(spark, ranges):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.7 + 0.3 * y, 2)
    rows = table(spark, y, s, model="m").unionByName(table(spark, 1 - y[:90], s[:90], model="n"))
    got = {r["model"]: r for r in M.summary(rows, ["model"], ranges=ranges).collect()}
    for name, (labels, scores) in {"m": (y, s), "n": (1 - y[:90], s[:90])}.items():
        r = got[name]
        want = brute(labels, scores)
        assert [r[c] for c in ("min_dcf", "threshold", "far", "miss", "auc", "ap")] == pytest.approx(want)


def test_eer_uses_corner_points_only(spark):
    rows = table(spark, *SIX)
    curve = M.score_curve(rows, [])
    points = [(r["fpr"], r["tpr"]) for r in M.roc_points(curve, []).orderBy(F.desc("threshold")).collect()]
    # Two synthetic clips on top, then one real at .6 and one at .4 (collinear), .2 synthetic, .1 real.
    want = [(0, 0), (0, 1 / 3), (0, 2 / 3), (2 / 3, 2 / 3), (2 / 3, 1), (1, 1)]
    assert np.allclose(points, want)
    # |fpr - fnr| is 1/3 at both (0, 2/3) and (2/3, 2/3); the higher threshold comes first.
    assert M.eer(curve, []).first()["eer"] == pytest.approx(1 / 6)


def test_split_plan_equals_plain_plan(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame(
        [("hot" if i % 3 else f"k{i % 7}", int(i), float(rng.random())) for i in range(900)],
        "k string, i int, x double",
    )
    from clipscore.operators.ordered import running

    def run(hot_rows):
        out = running(rows, ["k"], ["x", "i"], {"n": F.lit(1), "v": F.col("i")}, ["i"], hot_rows=hot_rows)
        return sorted(map(tuple, out.collect()))

    assert run(10**9) == run(20)


def test_many_hot_keys_and_tied_first_columns_are_cut(spark):
    """Each of forty keys with values of its own gets ranges of its own, and so does one whose first order column is constant."""
    from clipscore.operators import ordered

    rows = spark.createDataFrame([(f"k{k}", 7 if k == 0 else k * 1000 + i, i) for k in range(40) for i in range(200)], "k string, x int, i int")
    cut = ordered._split_hot(rows, ["k"], ["x", "i"], 20)
    sizes = cut.groupBy("k", "_b").count().groupBy("k").agg(F.count("*").alias("ranges"), F.max("count").alias("most")).collect()
    assert len(sizes) == 40 and min(r["ranges"] for r in sizes) >= 15 and max(r["most"] for r in sizes) < 60
    got = ordered.ranked(rows, ["k"], ["x", "i"], hot_rows=20).collect()
    assert all(r["rn"] == r["i"] + 1 for r in got)
    whole = ordered.ranked(rows, [], ["x", "i"], hot_rows=500)
    assert sorted(r["rn"] for r in whole.collect()) == list(range(1, 8001))


def test_medians_and_stability_under_hot_keys(spark):
    rng = np.random.default_rng(2)
    a = np.round(rng.random(301), 2)
    b = np.clip(a + np.round(rng.normal(0, 0.1, 301), 2), 0, 1)
    rows = spark.createDataFrame([("x", float(p), float(q)) for p, q in zip(a, b)], "k string, a double, b double")
    for hot in (10**9, 9):
        med = grouping.medians(rows, ["k"], {"m": "a"}, hot_rows=hot).first()["m"]
        assert med == pytest.approx(np.median(a))
        r = M.stability(rows, ["k"], "a", "b", hot_rows=hot).first()

        def rank(v):
            return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

        assert r["rank_correlation"] == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
        assert r["mean_change"] == pytest.approx(np.abs(a - b).mean())


def test_constant_scores_have_no_rank_correlation(spark):
    rows = spark.createDataFrame([("x", 0.5, float(i)) for i in range(4)], "k string, a double, b double")
    assert M.stability(rows, [], "a", "b").first()["rank_correlation"] is None


def test_confusion_golden(spark):
    r = M.confusion(table(spark, *SIX), []).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (2, 1, 1, 2)
    assert r["accuracy"] == pytest.approx(4 / 6)


def test_top_models_keep_list_order_on_ties(spark):
    rows = spark.createDataFrame([("b", 0, 0.5), ("a", 1, 0.5), ("c", 2, 0.4)], "model string, pos int, min_dcf double")
    got = [r["model"] for r in comparison.top_models(rows, [], 2).orderBy("place").collect()]
    assert got == ["c", "b"]
