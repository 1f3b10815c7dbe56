"""Fit registry, choice for unseen data and nested fusion against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clipscore.operators import models as Mo
from clipscore.operators import registry as Rg
from clipscore.plans import compare, fusion, unseen


class Mean:
    """Scores a clip by its x plus the mean label of the training rows."""

    def __init__(self, df, calls, shift):
        self.mean = df.agg(F.avg("label")).first()[0] * 0.01 + shift
        calls.append(shift)

    def score(self, df):
        return df.withColumn("score", F.col("x") + self.mean)

    def save(self, path):
        pass


def clips(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [(i, i % 2, f"g{i % 10}", rng.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "clip_id int, label int, grp string, x double")


def test_registry_fits_each_pair_once_and_resumes(spark, tmp_path):
    rows, df = clips(spark)
    folds = df.select("grp").distinct().withColumn("fold", F.substring("grp", 2, 1).cast("int") % 3)
    calls: list = []
    makers = {"a": lambda d: Mean(d, calls, 0.1), "b": lambda d: Mean(d, calls, 0.2)}

    def broken(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        Rg.build(df, folds, 3, {"a": makers["a"], "b": broken}, f"{tmp_path}/r", df.limit(5))
    made = Rg.build(df, folds, 3, makers, f"{tmp_path}/r", df.limit(5))
    assert sorted(calls) == [0.1] * 4 + [0.2] * 4
    Rg.build(df, folds, 3, makers, f"{tmp_path}/r", df.limit(5))
    assert len(calls) == 8
    fold_of = {f"g{i}": i % 3 for i in range(10)}
    got = {(r.model, r.clip_id): (r.fold, r.score) for r in made.out_of_fold(spark).collect()}
    assert len(got) == 120
    for i, _, grp, x in rows:
        rest = [label for _, label, g, _ in rows if fold_of[g] != fold_of[grp]]
        assert got["b", i] == (fold_of[grp], pytest.approx(x + 0.01 * sum(rest) / len(rest) + 0.2))
    assert made.unseen(spark).count() == 10 and not Rg.committed(spark, made.place("a", 7))


def test_corpora_share_held_out_groups(spark, tmp_path):
    _, old = clips(spark)
    new = old.select((F.col("clip_id") + 100).alias("clip_id"), "label", F.when(F.col("label") == 0, F.concat(F.lit("real:"), "grp")).otherwise(F.col("grp")).alias("grp"), "x")
    digit = F.expr("cast(right(grp, 1) as int)")
    folds = old.unionByName(new).select("grp").distinct().withColumn("fold", digit % 2)
    seen: list = []

    class Taught(Mean):
        def __init__(self, d):
            seen.append((d.where("clip_id >= 100 AND label = 0").count(), d.where("clip_id >= 100 AND label = 1").count(), d.select(digit % 2).distinct().count()))
            self.mean = 0.0

    out = compare.corpus_expansion(old, new, folds, 2, Taught, f"{tmp_path}/c")
    got = {(r.training, r.fold): r.auc for r in out.collect()}
    assert sorted(got) == sorted((t, f) for t in ("original", "speakers", "expanded") for f in (-1, 0, 1))
    assert len({got[t, -1] for t in ("original", "speakers", "expanded")}) == 1  # the same clips are scored
    assert all(parts == 1 for *_, parts in seen) and len(seen) == 6
    assert {bool(r) for r, s, _ in seen[:2]} == {False} and sum(r for r, _, _ in seen[2:4]) == 30
    assert sum(s for _, s, _ in seen[2:4]) == 0 and sum(r + s for r, s, _ in seen[4:]) == 60


def test_incomplete_scores_are_an_error(spark, tmp_path):
    _, df = clips(spark)
    folds = df.select("grp").distinct().withColumn("fold", F.lit(0))

    class Holes(Mean):
        def score(self, rows):
            return rows.withColumn("score", F.when(F.col("clip_id") == 3, float("nan")).otherwise(0.5))

        def __init__(self, d):
            pass

    with pytest.raises(ValueError):
        Rg.build(df, folds, 1, {"holes": Holes}, f"{tmp_path}/h")


def test_blends_are_read_from_scores(spark):
    rows = [(c, 0, "g", f, m, s) for c in range(4) for f in (0, -1) for m, s in (("a", 0.2 * c), ("b", 0.1), ("c", 1.0))]
    scores = spark.createDataFrame(rows, "clip_id int, label int, grp string, fold int, model string, score double")
    out = Rg.with_blends(scores, {"ab": {"a": 0.75, "b": 0.25}, "cc": {"c": 0.5}})
    got = {(r.model, r.clip_id, r.fold): r.score for r in out.collect()}
    assert len(got) == 40
    assert all(got["ab", c, f] == pytest.approx(0.15 * c + 0.025) and got["cc", c, f] == 0.5 for c in range(4) for f in (0, -1))
    assert Rg.with_blends(scores, {}) is scores


def scored(spark, seed, shift):
    rng = random.Random(seed)
    rows = [(i, i % 2, f"{'real' if i % 2 == 0 else 'attack'}{i % 5}", m, round(rng.random() * 0.6 + 0.4 * (i % 2) * k + shift, 3)) for i in range(200) for m, k in (("good", 1), ("bad", 0), ("twin", 1))]
    rows = [(i, y, g, m, s if m != "twin" else next(t for j, _, _, n, t in rows if j == i and n == "good")) for i, y, g, m, s in rows]
    return rows, spark.createDataFrame(rows, "clip_id int, label int, grp string, model string, score double")


def test_choice_uses_out_of_fold_scores_alone(spark):
    _, oof = scored(spark, 1, 0.0)
    rows, new = scored(spark, 2, 0.05)
    listed = ["bad", "twin", "good"]
    chosen = {r.model: r for r in unseen.ranking(oof, listed).collect()}
    assert chosen["twin"].chosen and not chosen["good"].chosen  # equal costs: list order
    only = {r.model: r for r in unseen.transferred(oof, new, listed, ["bad", "good"]).collect()}
    assert [m for m, r in only.items() if r.chosen] == ["good"]
    for model, r in only.items():
        real = [s for _, y, _, m, s in rows if m == model and y == 0]
        assert r.far == pytest.approx(sum(s >= r.cutoff for s in real) / len(real))
    recall = {(r.grp, r.model): (r.spoofs, r.recall) for r in unseen.attack_recall(oof, new).collect()}
    assert {g for g, _ in recall} == {f"attack{i}" for i in range(5)}
    found = [s >= only["good"].cutoff for _, y, g, m, s in rows if m == "good" and g == "attack3"]
    assert recall["attack3", "good"] == (len(found), pytest.approx(sum(found) / len(found)))
    assert unseen.best_pair(oof, listed) == ("twin", "good")


def test_weights_of_an_outer_fold_do_not_see_it(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, i % 3, rng.random(), rng.random() * 0.5 + 0.5 * (i % 2), rng.choice(["consistent", "inconsistent"])) for i in range(300)]
    df = spark.createDataFrame(rows, "clip_id int, label int, outer int, base double, temporal double, status string")
    sides = F.explode(F.sequence(F.lit(0), F.lit(2)))

    def weights(table):
        train = table.withColumnRenamed("outer", "own").withColumn("outer", sides).where("outer <> own")
        return {r.outer: tuple(r) for r in fusion.nested_systems(train, table)[0].collect()}

    flipped = df.withColumn("label", F.when(F.col("outer") == 1, 1 - F.col("label")).otherwise(F.col("label")))
    before, after = weights(df), weights(flipped)
    assert len(before) == 3 and before[1] == after[1] and before[0] != after[0]
    train = df.withColumnRenamed("outer", "own").withColumn("outer", sides).where("outer <> own")
    out = fusion.nested_systems(train, df)[1]
    got = {(r.clip_id, r.system): r.score for r in out.collect()}
    assert len(got) == 1500
    for i, _, o, base, temporal, status in rows[:40]:
        t, m = before[o][1], before[o][2]
        pulled = base * (1 - m) if status == "consistent" else base
        assert got[i, "nested_fusion"] == pytest.approx(t * temporal + (1 - t) * pulled)
    assert {r.outer for r in fusion.report(out).collect()} == {-1, 0, 1, 2}


def vectors(spark, n=240, seed=5):
    rng = random.Random(seed)
    rows = [(i, i % 2, f"{'real:' if i % 2 == 0 else 'synthetic:'}{i % 12}", [rng.gauss(0.6 * (i % 2) * (j < 2) + 3 * j, 1 + j) for j in range(6)] + [2.5]) for i in range(n)]
    df = spark.createDataFrame(rows, "clip_id bigint, label int, grp string, v array<double>")
    return df.withColumn("status", F.lit("consistent")).repartition(3).persist()


def test_logistic_models_of_all_sets_share_passes(spark, tmp_path):
    df = vectors(spark)
    folds = df.select("grp").distinct().withColumn("fold", F.pmod(F.xxhash64("grp"), F.lit(3)))
    specs = {"balanced": Mo.Spec("a", c=0.1), "cost": Mo.Spec("b", c=1.0, weighting="cost"), "few": Mo.Spec("c", columns=(0, 2, 6))}
    train, new = df.where("clip_id < 200"), df.where("clip_id >= 200")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    made = Rg.build(train, folds, 3, {k: Mo.Maker(s) for k, s in specs.items()}, f"{tmp_path}/s", new)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 120  # one fit after another takes several times as many
    got = {(r.model, r.fold, r.clip_id): r.score for r in made.scores(spark).collect()}
    alone = Rg.build(train, folds, 3, {k: (lambda d, s=s: Mo.fit(d, s)) for k, s in specs.items()}, f"{tmp_path}/a", new)
    want = {(r.model, r.fold, r.clip_id): r.score for r in alone.scores(spark).collect()}
    assert set(got) == set(want) and len(got) == 720
    assert max(abs(got[k] - want[k]) for k in want) < 1e-4
    model = made.model("few")
    kept = {r.clip_id: r.score for r in model.score(new).select("clip_id", "score").collect()}
    assert all(kept[c] == pytest.approx(s, abs=1e-12) for (m, f, c), s in got.items() if m == "few" and f == -1)


def test_nested_and_corpus_fits_share_passes(spark, tmp_path):
    df = vectors(spark)
    makers = {"one": Mo.Spec("one", c=0.1), "two": Mo.Spec("two", c=1.0, columns=(0, 1))}
    key = ["outer", "fold", "model", "clip_id"]
    got, want = (
        {tuple(r[k] for k in key): r.score for r in fusion.cross_scores(df, m, f"{tmp_path}/{n}", 3, 2).collect()}
        for n, m in (("s", {k: Mo.Maker(s) for k, s in makers.items()}), ("a", {k: (lambda d, s=s: Mo.fit(d, s)) for k, s in makers.items()}))
    )
    assert set(got) == set(want) and len(got) == 2 * 3 * 240
    assert max(abs(got[k] - want[k]) for k in want) < 1e-4
    folds = df.select("grp").distinct().withColumn("fold", F.expr("CAST(substring_index(grp, ':', -1) AS INT) % 4 > 1").cast("int"))
    old, new, spec = df.where("clip_id % 3 > 0"), df.where("clip_id % 3 = 0"), makers["one"]
    for name, maker in (("s", Mo.Maker(spec)), ("a", lambda d: Mo.fit(d, spec))):
        compare.corpus_expansion(old, new, folds, 2, maker, f"{tmp_path}/c{name}").collect()
    shared, alone = ({(r.model, r.fold, r.clip_id): r.score for r in Rg.Registry(f"{tmp_path}/c{n}").scores(spark).collect()} for n in "sa")
    assert set(shared) == set(alone) and max(abs(shared[k] - alone[k]) for k in alone) < 1e-4
