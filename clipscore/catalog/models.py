"""Model queries (K2-K14, K18, K19, K23-K27, G13): fitted on the shared vectors, so checked by
properties (bounds, completeness, sums) rather than by SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from clipscore import views
from clipscore.catalog.common import Catalog, r6, s6, with_
from clipscore.catalog.metrics import LONG, curve_sql
from clipscore.functions import scores as S
from clipscore.operators import comparison, splits
from clipscore.operators import metrics as M
from clipscore.operators import models as Mo
from clipscore.operators import registry as Rg
from clipscore.operators.machines import machine_scores
from clipscore.plans import compare, fusion, holdout_routing, tuning

catalog = Catalog()

SPECTRAL = tuple(range(20))

# Queries that fit a forest for every fold, generator or partition take this size; single fits the full one.
FOLD_FOREST = {"trees": 40, "depth": 8}


def rows(spark, sf):
    """Embeddings as feature vectors; the label follows the ten-class cluster, and each class has
    its own namespaced groups."""
    label = (F.col("label") >= 5).cast("int")
    group = F.when(label == 0, F.concat(F.lit("real:"), (F.col("vec_id") % 12).cast("string")))
    group = group.otherwise(F.concat(F.lit("synthetic:"), (F.col("label") % 4).cast("string")))
    # One file is one partition here; fits and scores are dealt to all cores.
    return Mo.spread(views.table(spark, sf, "embeddings")).select(
        F.col("vec_id").alias("clip_id"),
        label.alias("label"),
        group.alias("grp"),
        F.transform("embedding", lambda v: v.cast("double")).alias("v"),
    )


def sides(spark, sf):
    data = rows(spark, sf).persist()
    return data.where("clip_id % 4 <> 0"), data.where("clip_id % 4 = 0")


def scored(model, df):
    return model.score(df).select("clip_id", "label", r6("score").alias("score"))


@catalog.add("k2_logistic")
def k2_logistic(spark, sf):
    train, test = sides(spark, sf)
    return scored(Mo.fit(train, Mo.Spec("logistic", "logistic", c=0.1)), test)


@catalog.add("k3_rbf_svm")
def k3_rbf_svm(spark, sf):
    """Margins of the kernel machine before calibration."""
    train, test = sides(spark, sf)
    model = Mo.fit(train, Mo.Spec("svm", "svm"), calibrate=False)
    return model.margin(test).select("clip_id", "label", r6("margin").alias("margin"))


@catalog.add("k4_calibrated_svm")
def k4_calibrated_svm(spark, sf):
    train, test = sides(spark, sf)
    return scored(Mo.fit(train, Mo.Spec("svm", "svm", c=3.0)), test)


def blend_specs(weight=0.75):
    return Mo.svm_logistic("v", weight)


@catalog.add("k5_svm_logistic_blend")
def k5_svm_logistic_blend(spark, sf):
    train, test = sides(spark, sf)
    return scored(Mo.fit_blend(train, blend_specs()), test)


def forests(train):
    return Mo.fit_blend(train, Mo.two_forests(SPECTRAL, "v"))


@catalog.add("k6_two_forests")
def k6_two_forests(spark, sf):
    train, test = sides(spark, sf)
    return scored(forests(train), test)


@catalog.add("k7_extra_trees")
def k7_extra_trees(spark, sf):
    train, test = sides(spark, sf)
    return scored(Mo.fit(train, Mo.Spec("trees", "trees", weighting="cost")), test)


def labelled_clips(spark, sf, lowpass=None):
    """Feature views of the labelled documents rendered as clips."""
    from clipscore.operators import clip_features as CF

    labels = views.scored(spark, sf).select("clip_id", "label", "grp")
    clips = views.clips(spark, sf).join(labels.select("clip_id"), "clip_id", "left_semi")
    good, _ = CF.features(clips, ("base", "lfcc"), lowpass_hz=lowpass)
    return good.join(labels, "clip_id").select(
        "clip_id", "label", "grp", F.concat("base", "lfcc").cast("array<double>").alias("v")
    )


@catalog.add("k8_common_band_forest")
def k8_common_band_forest(spark, sf):
    """One forest on 204 features of the clips as they are and one on the band-limited clips."""
    parts = []
    for name, cutoff in (("raw", None), ("common_band", 1_500.0)):
        data = labelled_clips(spark, sf, cutoff).persist()
        model = Mo.fit(data.where("clip_id % 3 <> 0"), Mo.Spec("forest", "forest", **FOLD_FOREST))
        out = model.score(data.where("clip_id % 3 = 0"))
        parts.append(out.select("clip_id", F.lit(name).alias("view"), "label", r6("score").alias("score")))
    return parts[0].unionByName(parts[1])


def three_views(df):
    """The compared views: all columns, and two disjoint parts of them."""
    parts = {"base_lfcc": F.col("v"), "temporal": F.slice("v", 1, 24), "base": F.slice("v", 25, 40)}
    return df.withColumns(parts)


@catalog.add("k9_ten_models")
def k9_ten_models(spark, sf):
    """The ten-model table on one grouped holdout, ranked by minDCF."""
    train, test = map(three_views, sides(spark, sf))
    machines = [s for s in Mo.COMPARISON if s.family == "svm"]
    others = [s for s in Mo.COMPARISON if s.family != "svm"]
    # The machines share their passes; the others are fitted beside them, two at a time.
    scores, fitted = Mo.parallel(
        [
            lambda: machine_scores(train, test, machines),
            lambda: Mo.parallel([lambda s=s: Mo.fit(train, s) for s in others], workers=2),
        ]
    )
    parts = [m.score(test).select("label", F.lit(m.spec.name).alias("model"), "score") for m in fitted]
    from clipscore.sources.checks import union

    pos = F.array_position(F.array(*[F.lit(s.name) for s in Mo.COMPARISON]), F.col("model")).cast("int") - 1
    rows = union([scores.select("label", "model", "score"), *parts]).withColumn("pos", pos)
    costs = M.summary(rows, ["model", "pos"])
    out = comparison.top_models(costs, [], len(Mo.COMPARISON))
    return out.select("model", "place", *[r6(c).alias(c) for c in ("min_dcf", "auc", "eer")])


def makers():
    return {
        "logistic": lambda d: Mo.fit(d, Mo.Spec("logistic", "logistic", c=0.1)),
        "forest": lambda d: Mo.fit(d, Mo.Spec("forest", "forest", **FOLD_FOREST)),
    }


def oof_scores(spark, sf):
    data = rows(spark, sf).persist()
    folds = splits.greedy_folds(splits.group_sizes(data, ["label"], "grp"), ["label"], "grp", 4)
    return data, Mo.out_of_fold(data, folds.select("grp", "fold"), 4, makers()).persist()


@catalog.add("k10_oof_scores")
def k10_oof_scores(spark, sf):
    """Out-of-fold scores of a logistic model, of two forests and of their composite, which is read from their
    scores; clips without exactly one finite score per model would be an error."""
    data = rows(spark, sf)
    folds = splits.greedy_folds(splits.group_sizes(data, ["label"], "grp"), ["label"], "grp", 4)
    specs = [Mo.Spec("logistic", "logistic", c=0.1), *[s for s, _ in Mo.two_forests(SPECTRAL, "v", **FOLD_FOREST)]]
    fits = {s.name: Mo.Maker(s) for s in specs}
    made = Rg.build(data, folds.select("grp", "fold"), 4, fits, Mo.shared_path(spark))
    out = Rg.with_blends(made.out_of_fold(spark), {"two_forests": {"forest_full": 0.5, "forest_spectral": 0.5}})
    return out.withColumn("score", r6("score"))


@catalog.add("k11_select_and_refit")
def k11_select_and_refit(spark, sf):
    data, oof = oof_scores(spark, sf)
    path = Mo.shared_path(spark)
    name, _ = Mo.choose_and_refit(data, oof, makers(), path)
    return scored(Mo.Fitted.load(path), data).withColumn("model", F.lit(name))


@catalog.add("k12_train_report")
def k12_train_report(spark, sf):
    """Train-command metrics: grouped holdout, two forests, container-adjusted scores."""
    from clipscore.plans.train import holdout_report

    status = F.when(F.col("clip_id") % 5 < 3, "consistent").otherwise("inconsistent")
    data = rows(spark, sf).withColumn("status", status).persist()
    split = splits.group_split(data, "label", "grp", 0.25, 42)
    model = forests(split.where("side = 'train'"))
    return holdout_report(model.score(split.where("side = 'test'")), split)


@catalog.add("k13_batch_scores")
def k13_batch_scores(spark, sf):
    """Rendered clips scored as the batch command does: features, model, container prior, text; a rejected clip
    has its reason instead of a score."""
    from clipscore.functions.containers import with_verdict
    from clipscore.operators import clip_features as CF
    from clipscore.sources.sinks import score_text

    data = labelled_clips(spark, sf).persist()
    model = Mo.fit(data, Mo.Spec("logistic", "logistic", c=0.1))
    clips = with_verdict(views.clips(spark, sf).withColumn("suffix", F.lit(".wav")))
    every, _ = CF.features(clips, ("base", "lfcc"), keep=("container",), together=True)
    out = model.score(every.withColumn("v", F.concat("base", "lfcc").cast("array<double>")))
    adjusted = S.container_adjusted(F.col("score"), F.col("container.status"))
    text = F.when(F.col("reason").isNull(), score_text(adjusted)).alias("cm-score")
    return out.select("clip_id", F.col("container.status").alias("status"), text, "reason")


@catalog.add("g13_feature_importance")
def g13_feature_importance(spark, sf):
    """Top-k report: twenty most important features of the two forests."""
    train, _ = sides(spark, sf)
    out = Mo.importance(forests(train), tuple(f"f{i:02d}" for i in range(64)))
    top = out.orderBy(F.desc("importance"), "feature").limit(20)
    return top.withColumn("importance", r6("importance"))


@catalog.add("k14_path_explanation")
def k14_path_explanation(spark, sf):
    """Baseline plus contributions against the score, and the strongest evidence per clip."""
    from clipscore.operators.sampling import top_contributions

    train, test = sides(spark, sf)
    model = forests(train)
    out = Mo.path_contributions(model.score(test), model, 64)
    total = F.aggregate("contributions", F.lit(0.0), lambda s, v: s + v)
    names = F.array(*[F.lit(f"f{i:02d}") for i in range(64)])
    top = F.get(top_contributions(F.col("contributions"), names), 0)
    return out.select(
        "clip_id",
        r6("score").alias("score"),
        r6("baseline").alias("baseline"),
        (F.abs(F.col("baseline") + total - F.col("score")) < 1e-9).alias("sums_to_score"),
        top["feature"].alias("strongest"),
    )


def with_status(spark, sf):
    return rows(spark, sf).withColumn("status", F.when(F.col("clip_id") % 5 < 3, "consistent").otherwise("inconsistent"))


@catalog.add("k18_select_penalty")
def k18_select_penalty(spark, sf):
    """The kernel machine's penalty by container-adjusted out-of-fold scores of all rows, five folds."""
    data = with_status(spark, sf)
    raw = tuning.path_scores(data, Mo.Spec("rbf_svm", "svm"), Mo.SVM_CS, Mo.shared_path(spark), 5, 0)
    scores = raw.join(data.select("clip_id", "status"), "clip_id")
    scores = scores.withColumn("score", S.container_adjusted(F.col("score"), F.col("status")))
    costs, best = tuning.penalty_costs(scores), tuning.choose_penalties(scores).select("outer", F.col("c").alias("best"))
    return costs.join(best, "outer").select("c", r6("min_dcf").alias("min_dcf"), (F.col("c") == F.col("best")).alias("chosen"))


@catalog.add("k18_nested_penalty")
def k18_nested_penalty(spark, sf):
    """Penalty chosen inside five outer folds on three inner ones, against the fixed blend, per outer fold and pooled."""
    chosen, systems = tuning.nested_penalty(with_status(spark, sf), Mo.Spec("rbf_svm", "svm"), Mo.shared_path(spark))
    out = fusion.report(systems).join(chosen.select("outer", "c"), "outer")
    return out.select("system", "outer", F.when(F.col("system") == "tuned", F.col("c")).alias("c"), *[r6(x).alias(x) for x in ("min_dcf", "auc", "ap")])


def conditions(spark, sf):
    """Two scores and a twelve-column condition vector per clip."""
    one = F.lit(1.0)
    return rows(spark, sf).select(
        "clip_id",
        "label",
        F.slice("v", 1, 12).alias("quality"),
        F.least(one, F.abs(F.get("v", 20)) * 2 + 0.2 * F.col("label")).alias("a"),
        F.least(one, F.abs(F.get("v", 21)) * 2 + 0.1 * F.col("label")).alias("b"),
        F.least(one, F.abs(F.get("v", 22)) * 2 + 0.15 * F.col("label")).alias("c"),
        F.least(one, F.abs(F.get("v", 23)) * 2).alias("d"),
        "grp",
    )


@catalog.add("k19_condition_router")
def k19_condition_router(spark, sf):
    data = conditions(spark, sf).persist()
    router = Mo.fit_condition_router(data, "quality", "a", "b")
    return router.alphas.select("cluster", "size", "own", "alpha")


@catalog.add("k23_cross_fitted_routing")
def k23_cross_fitted_routing(spark, sf):
    """Four models of which each fold's other folds choose two; no group is in two folds."""
    data = conditions(spark, sf)
    folds = splits.greedy_folds(splits.group_sizes(data, ["label"], "grp"), ["label"], "grp", 3)
    data = data.join(folds.select("grp", "fold"), "grp").persist()
    oof = data.select(
        "clip_id", "label", "fold", F.expr("stack(4, 'first', a, 'second', b, 'third', c, 'fourth', d) AS (model, score)")
    )
    out = holdout_routing.cross_fitted_routing(oof, data.select("clip_id", "quality"), 3, ["first", "second", "third", "fourth"])
    return M.summary(out.withColumn("score", F.round("score", 12)), ["policy", "fold"]).select(
        "policy", "fold", r6("min_dcf").alias("min_dcf"), r6("auc").alias("auc")
    )


@catalog.add("k24_forest_weight_sweep")
def k24_forest_weight_sweep(spark, sf):
    data = rows(spark, sf).persist()
    out = compare.forest_sweep(data, SPECTRAL, [1, 2], [0.0, 0.25, 0.5, 0.75, 1.0], **FOLD_FOREST)
    return out.select("weight", r6("mean_auc").alias("mean_auc"), r6("worst_auc").alias("worst_auc"))


@catalog.add("k25_view_ablation")
def k25_view_ablation(spark, sf):
    """Same folds, two views and their equal blend, metrics per system and fold."""
    data = rows(spark, sf).select(
        "clip_id", "label", "grp", F.slice("v", 1, 32).alias("left"), F.slice("v", 33, 32).alias("right")
    ).persist()
    specs = [Mo.Spec("left", "logistic", view="left", c=0.1), Mo.Spec("right", "logistic", view="right", c=0.1)]
    out = compare.ablation(data, specs, 3, 42)
    return out.select("system", "fold", *[r6(c).alias(c) for c in ("min_dcf", "auc", "ap")])


@catalog.add("k26_recorded_holdout")
def k26_recorded_holdout(spark, sf):
    data = rows(spark, sf).withColumn(
        "status", F.when(F.col("clip_id") % 5 < 3, "consistent").otherwise("unknown")
    ).persist()
    held = data.where("grp IN ('real:1', 'real:4', 'synthetic:2')").select("grp").distinct()
    out = compare.recorded_holdout(data, held, makers())
    return out.select("system", *[r6(c).alias(c) for c in ("min_dcf", "auc", "eer")])


@catalog.add("k27_candidate_vs_current")
def k27_candidate_vs_current(spark, sf):
    """Generator-paired partitions, out-of-fold scores of both models, cost at the chosen cutoff."""
    data = rows(spark, sf).persist()
    out = compare.candidate_vs_current(
        data.where("clip_id % 5 <> 0"), data.where("clip_id % 5 = 0"),
        makers()["forest"], makers()["logistic"], partitions=3,
    )
    return out.select("model", *[r6(c).alias(c) for c in ("mean_min_dcf", "cutoff", "holdout_dcf")])


PARTED = """parted AS (SELECT model, CAST(p AS INT) AS partition, label,
 round(CASE WHEN (clip_id * (p + 1)) % 7 = 0 THEN score * 9e-1 ELSE score END, 12) AS score FROM long, range(0, 3) r(p))"""


@catalog.add(
    "k27_cost_at_training_cutoff",
    with_(
        views.SCORED,
        LONG,
        PARTED,
        curve_sql("model, partition", "parted"),
        "cut AS (SELECT model, avg(cost) AS mean_cost, median(t) AS cutoff FROM best GROUP BY model)",
        """rt AS (SELECT l.model, max(mean_cost) AS mean_cost, max(cutoff) AS cutoff,
 avg(CASE WHEN label = 1 THEN CASE WHEN score < cutoff THEN 1e0 ELSE 0e0 END END) AS miss,
 avg(CASE WHEN label = 0 THEN CASE WHEN score >= cutoff THEN 1e0 ELSE 0e0 END END) AS fa
 FROM long l JOIN cut c ON l.model = c.model WHERE corpus = 'a' GROUP BY l.model)""",
    )
    + f" SELECT model, {s6('mean_cost')} AS mean_min_dcf, {s6('cutoff')} AS cutoff, {s6('(3e-1*miss + 28e-1*fa)/3e-1')} AS holdout_dcf FROM rt",
)
def k27_cost_at_training_cutoff(spark, sf):
    from clipscore.catalog.metrics import long_scores
    from clipscore.catalog.tables import partitioned

    per = M.min_dcf(partitioned(spark, sf), ["model", "partition"])
    holdout = long_scores(spark, sf).where("corpus = 'a'")
    out = compare.cost_at_training_cutoff(per, holdout)
    return out.select("model", *[r6(c).alias(c) for c in ("mean_min_dcf", "cutoff", "holdout_dcf")])


@catalog.add(
    "k18_penalty_choice",
    with_(
        views.SCORED,
        LONG,
        PARTED,
        curve_sql("model, partition", "parted"),
        """walked AS (SELECT partition, cost, CASE model WHEN 'secondary' THEN 1e-1 ELSE 1e0 END AS c,
 row_number() OVER (PARTITION BY partition ORDER BY round(cost, 12), CASE model WHEN 'secondary' THEN 0 ELSE 1 END) AS rn FROM best)""",
    )
    + f' SELECT partition AS "outer", CAST(c AS DOUBLE) AS c, {s6("cost")} AS inner_min_dcf FROM walked WHERE rn = 1',
)
def k18_penalty_choice(spark, sf):
    """The choice alone, on given scores that stand for those of two penalties."""
    from clipscore.catalog.tables import partitioned

    c = F.when(F.col("model") == "secondary", 0.1).otherwise(1.0)
    scores = partitioned(spark, sf).select(F.col("partition").alias("outer"), F.lit(0).alias("inner"), c.alias("c"), "label", "score")
    return tuning.choose_penalties(scores).withColumn("inner_min_dcf", r6("inner_min_dcf"))
