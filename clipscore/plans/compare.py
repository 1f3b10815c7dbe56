"""Model comparisons: weight sweeps, view ablation, recorded holdouts, candidate against current."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipscore.functions.scores import container_adjusted
from clipscore.operators import metrics as M
from clipscore.operators import models as Mo
from clipscore.operators import registry as Rg
from clipscore.operators import splits
from clipscore.operators.comparison import select_model, weight_sweep
from clipscore.sources import checks


def forest_sweep(
    df: DataFrame, spectral: tuple[int, ...], seeds: list[int], weights: list[float], trees: int = 300, depth: int = 12
) -> DataFrame:
    """Mean and worst AUC of full-forest weights over seeds and held-out generators.

    For each seed a quarter of the real groups is held out, together with one generator at a time;
    pairs lacking a class on a side are left out.
    """
    generators = [r["grp"] for r in df.where("label = 1").select("grp").distinct().orderBy("grp").collect()]
    real = splits.seeded_group_ranks(df.where("label = 0").select("grp").distinct(), "grp", seeds)
    share = F.ceil(F.lit(0.25) * df.where("label = 0").agg(F.count_distinct("grp")).first()[0])
    held = real.where(F.col("rn") <= share).select("seed", "grp")
    full, part = (s for s, _ in Mo.two_forests(spectral, "v", trees, depth))

    def one(seed: int, generator: str):
        def run() -> DataFrame:
            out = held.where(F.col("seed") == seed).select("grp").withColumn("_h", F.lit(True))
            rows = df.join(out, "grp", "left")
            test = F.coalesce("_h", F.lit(False)) | (F.col("grp") == generator)
            train = rows.where(~test).drop("_h")
            scored = Mo.fit(train, full).score(rows.where(test), "full")
            scored = Mo.fit(train, part).score(scored, "spectral")
            return scored.select(F.lit(seed).alias("seed"), F.lit(generator).alias("generator"), "label",
                                 "full", "spectral")

        return run

    runs = Mo.parallel([one(s, g) for s in seeds for g in generators])
    return weight_sweep(checks.union(runs), ["seed", "generator"], "full", "spectral", weights)


def ablation(df: DataFrame, specs: list[Mo.Spec], folds: int, seed: int) -> DataFrame:
    """Out-of-fold metrics per system and fold (fold -1: pooled); the equal blend is a system too."""
    placed = splits.stratified_group_folds(df, "label", "grp", folds, seed).select("grp", "fold")
    makers = {s.name: (lambda d, s=s: Mo.fit(d, s)) for s in specs}
    oof = Mo.out_of_fold(df, placed, folds, makers).persist()
    mean = oof.groupBy("clip_id", "label", "grp", "fold").agg(F.avg("score").alias("score"))
    systems = oof.withColumnRenamed("model", "system").unionByName(
        mean.withColumn("system", F.lit("equal_blend"))
    )
    scoped = systems.withColumn("fold", F.explode(F.array(F.col("fold").cast("int"), F.lit(-1))))
    return M.summary(scoped, ["system", "fold"])


def recorded_holdout(df: DataFrame, held: DataFrame, makers: dict) -> DataFrame:
    """Systems trained without the recorded groups and scored on them, container-adjusted."""
    train = df.join(held, "grp", "left_anti").persist()
    test = df.join(held, "grp", "left_semi").persist()

    def one(name: str):
        def run() -> DataFrame:
            scored = makers[name](train).score(test)
            score = container_adjusted(F.col("score"), F.col("status"))
            return scored.select(F.lit(name).alias("system"), "label", score.alias("score"))

        return run

    return M.summary(checks.union(Mo.parallel([one(n) for n in makers])), ["system"])


def corpus_expansion(
    old: DataFrame, new: DataFrame, folds: DataFrame, n_folds: int, maker, path: str, prefix: str = "real:"
) -> DataFrame:
    """Metrics of one model trained on three corpora: the old clips, these with the new clips of real speakers, and
    all; per corpus (``training``) and fold, and pooled (fold -1).

    The held-out groups are the same for all corpora and leave each of them; only old clips are scored
    in the report.  Fits lie in one registry keyed by (corpus, fold).
    """
    spark = old.sparkSession
    corpora = {
        "original": old,
        "speakers": old.unionByName(new.where(F.col("grp").startswith(prefix))),
        "expanded": old.unionByName(new),
    }
    if Rg.shareable({"": maker}):
        _fit_together(old, new, folds, n_folds, maker.spec, list(corpora), path, prefix)
    for name, corpus in corpora.items():
        made = Rg.build(corpus, folds, n_folds, {name: maker}, path)
    scores = made.out_of_fold(spark).join(old.select("clip_id"), "clip_id", "left_semi")
    scoped = scores.withColumn("fold", F.explode(F.array("fold", F.lit(-1))))
    return M.summary(scoped.withColumnRenamed("model", "training"), ["training", "fold"])


def _fit_together(old: DataFrame, new: DataFrame, folds: DataFrame, n_folds: int, spec: Mo.Spec, names: list[str], path: str, prefix: str) -> None:
    """The fits of all (corpus, fold) in the same passes; the corpora are nested, so a clip is in the last ones of the list."""
    first = F.when(~F.col("_new"), 0).when(F.col("grp").startswith(prefix), 1).otherwise(2)
    both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    rows = both.join(folds.select("grp", F.col("fold").cast("int").alias("fold")), "grp").withColumn("_first", first)
    corpora, sets = F.sequence("_first", F.lit(len(names) - 1)), F.array(*map(F.lit, range(n_folds)))
    others = F.filter(sets, lambda k: k != F.col("fold"))
    trains = F.flatten(F.transform(corpora, lambda c: F.transform(others, lambda k: c * n_folds + k)))
    held = F.transform(corpora, lambda c: c * n_folds + F.col("fold"))
    rows = rows.select("clip_id", "label", "grp", spec.view, trains.alias("trains"), held.alias("held")).persist()
    try:
        Rg.fit_together(rows, {c * n_folds + k: (path, k, {name: spec}) for c, name in enumerate(names) for k in range(n_folds)})
    finally:
        rows.unpersist()


def cost_at_training_cutoff(per_partition: DataFrame, holdout: DataFrame) -> DataFrame:
    """Mean training minDCF, median cutoff, and the cost of that cutoff on the holdout, per model."""
    chosen = select_model(per_partition).select("model", "mean_min_dcf", "cutoff", "chosen")
    rows = holdout.join(chosen, "model")
    keys = ["model", "mean_min_dcf", "cutoff", "chosen"]
    return M.dcf_at(rows, keys, F.col("cutoff")).withColumnRenamed("dcf", "holdout_dcf")


def candidate_vs_current(train: DataFrame, holdout: DataFrame, current, candidate, partitions: int = 3) -> DataFrame:
    """Both models over generator-paired partitions, then on the holdout at their own cutoffs."""
    folds = splits.partition_folds(train, "label", "grp", partitions).persist()
    n = folds.where("partition = 0").agg(F.max("fold")).first()[0] + 1
    makers = {"current": current, "candidate": candidate}
    parts = [
        Mo.out_of_fold(
            train, folds.where(F.col("partition") == p).drop("partition"), n, makers, ("label", "grp")
        ).withColumn("partition", F.lit(p))
        for p in range(partitions)
    ]
    oof = checks.union(parts).persist()
    gaps = splits.completeness(
        oof, ["model", "partition"], train.select("clip_id"), oof.select("model", "partition")
    )
    checks.fail_if_any(gaps, "out-of-fold scores")
    per = M.min_dcf(oof, ["model", "partition"])
    final = checks.union(
        [make(train).score(holdout).select(F.lit(name).alias("model"), "label", "score") for name, make in makers.items()]
    )
    return cost_at_training_cutoff(per, final)
