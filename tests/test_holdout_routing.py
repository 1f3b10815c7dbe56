"""Clustering of overlapping sets and routing on group holdouts against plain numpy."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipscore.operators.clusters import keyed_kmeans
from clipscore.operators.routing import select_alpha
from clipscore.plans import holdout_routing as H


def conditions(spark, n=300, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind, label = i % 3, (i // 3) % 2
        quality = [10.0 * (kind == d) + rng.gauss(0, 0.3) for d in range(3)] + [7.0]
        good, poor = 0.2 + 0.5 * label + rng.gauss(0, 0.05), rng.random()
        a, b = (good, poor) if kind == 0 else (poor, good)
        rows.append((i, label, f"g{i % 17}", quality, a, b))
    return rows, spark.createDataFrame(rows, "clip_id int, label int, grp string, q array<double>, a double, b double")


def test_each_set_has_clusters_of_its_own_rows(spark):
    rows, df = conditions(spark)
    keyed = df.withColumn("keys", F.when(F.col("clip_id") < 150, F.expr("array(0, 1)")).otherwise(F.array(F.lit(1))))
    got = {r.key: r for r in keyed_kmeans(keyed, "q", "keys", "clip_id", restarts=6, min_size=20).collect()}
    again = {r.key: r for r in keyed_kmeans(keyed.repartition(7), "q", "keys", "clip_id", restarts=6, min_size=20).collect()}
    for key, own in ((0, rows[:150]), (1, rows)):
        q, r = np.array([x[3] for x in own]), got[key]
        assert r.n == len(own) and len(r.centers) == 3
        assert r.mean == pytest.approx(q.mean(0)) and r.scale[:3] == pytest.approx(q.std(0)[:3]) and r.scale[3] == 1.0
        z, c = (q - np.array(r.mean)) / np.array(r.scale), np.array(r.centers)
        gaps = ((z[:, None] - c) ** 2).sum(-1)
        near = gaps.argmin(1)
        assert all(len(set(near[k::3])) == 1 for k in range(3)) and len(set(near[:3])) == 3
        for i in range(3):
            assert c[i] == pytest.approx(z[near == i].mean(0), abs=1e-9)
        assert r.cost == pytest.approx(gaps.min(1).sum()) and again[key].cost == pytest.approx(r.cost)


def test_small_and_empty_sets(spark):
    _, df = conditions(spark, 30)
    keyed = df.withColumn("keys", F.array(F.lit(0)))
    one = keyed_kmeans(keyed, "q", "keys", "clip_id", clusters=3, min_size=40).first()
    assert len(one.centers) == 1 and one.centers[0] == pytest.approx([0.0] * 4, abs=1e-9)
    assert keyed_kmeans(keyed.where("false"), "q", "keys", "clip_id").count() == 0


def test_holdouts_never_see_held_groups(spark):
    rows, df = conditions(spark)
    for r in H.roles(df).collect():
        assert H.FINAL in r.train and not set(r.train) & set(r.test)
        assert set(r.train) | set(r.test) == {H.FINAL, *range(5)}
    held = {(f, r.grp) for r in H.roles(df).collect() for f in r.test}
    assert all(sum(f == k for f, _ in held) == 5 for k in range(5))  # a quarter of 17 groups, rounded up


def test_clusters_route_to_the_better_score(spark):
    _, df = conditions(spark, 600)
    report, router = H.evaluate(df, "q", "a", "b", min_size=40, restarts=5)
    got = {r.fold: r for r in report.collect()}
    assert set(got) == {None, 0, 1, 2, 3, 4}
    folds = [got[f] for f in range(5)]
    assert got[None].conditional_dcf == pytest.approx(sum(r.conditional_dcf for r in folds) / 5)
    assert got[None].conditional_dcf < got[None].overall_dcf
    alphas = sorted(r.alpha for r in router.alphas.collect())
    assert len(alphas) == 3 and alphas[0] < 0.5 < alphas[2] and router.centers.count() == 3


def test_cross_fitted_routing_shares_its_passes(spark):
    """The restarts of all folds' clusterings advance together: jobs do not multiply by folds and restarts."""
    _, df = conditions(spark)
    data = df.withColumn("fold", F.pmod(F.xxhash64("grp"), F.lit(3)).cast("int")).withColumn("quality", F.col("q"))
    oof = data.select("clip_id", "label", "fold", F.expr("stack(3, 'a', a, 'b', b, 'c', 0.5D) AS (model, score)"))
    spark.sparkContext.setJobGroup("cross_fitted", "routing")
    try:
        out = H.cross_fitted_routing(oof, data.select("clip_id", "quality"), 3, ["a", "b", "c"]).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("cross_fitted")) < 250
    assert len(out) == 2 * data.count()
    got = {(r.clip_id, r.policy): r.score for r in out}
    for f in range(3):
        best = select_alpha(data.where(F.col("fold") != f).withColumn("k", F.lit(0)), ["k"], "a", "b").first()["alpha"]
        for r in data.where(F.col("fold") == f).collect():
            assert got[r.clip_id, "overall"] in (pytest.approx(best * r.a + (1 - best) * r.b), pytest.approx(best * r.b + (1 - best) * r.a))
    with pytest.raises(ValueError, match="both classes"):
        H.cross_fitted_routing(oof.where("label = 1"), data.select("clip_id", "quality"), 3, ["a", "b", "c"]).collect()


def test_rows_of_few_holdouts_stay_spread_over_tasks(spark):
    rows = spark.range(0, 4_000, 1, 16).select(F.col("id").alias("clip_id"), (F.col("id") % 2).cast("int").alias("fold"), F.array(F.rand(1), F.rand(2)).alias("quality"))
    fits = spark.createDataFrame([(k, [0.5, 0.5], [1.0, 1.0], [[-0.2, 0.0], [0.2, 0.0]]) for k in (0, 1)], "key int, mean array<double>, scale array<double>, centers array<array<double>>")
    placed = H.placed(rows, fits, "quality")
    sizes = placed.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) == 250
