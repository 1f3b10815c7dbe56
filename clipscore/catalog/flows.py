"""Flows of several steps: from out-of-fold choice to unseen data (K9-K11, I8, G6), nested fusion (K17 inside J9),
routing on group holdouts (K19-K22 on J8)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from clipscore import views
from clipscore.catalog.common import Catalog, r6, s6, with_
from clipscore.catalog.metrics import AUC_SQL, LONG, curve_sql, long_scores
from clipscore.catalog.models import conditions, rows, three_views
from clipscore.catalog.routing import ROWS, routed_rows
from clipscore.catalog.selection import counts_sql, recursive, share_sql
from clipscore.operators import models as Mo
from clipscore.operators import registry as Rg
from clipscore.operators import splits
from clipscore.plans import compare, fusion, holdout_routing, unseen

catalog = Catalog()

# Given scores stand for fitted ones: corpus a is unseen, the others are out-of-fold.
TRANSFER = (
    views.SCORED,
    LONG,
    "oof AS (SELECT * FROM long WHERE corpus <> 'a')",
    "dev AS (SELECT * FROM long WHERE corpus = 'a')",
    curve_sql("model", "oof"),
)


@catalog.add(
    "k11_unseen_transfer",
    with_(*TRANSFER)
    + f""" SELECT d.model, {s6('max(cost)')} AS oof_min_dcf, {s6('max(t)')} AS cutoff,
 d.model = (SELECT model FROM best ORDER BY round(cost, 9), CASE model WHEN 'secondary' THEN 0 ELSE 1 END LIMIT 1) AS chosen,
 {s6('avg(CASE WHEN label = 0 THEN CASE WHEN score >= t THEN 1e0 ELSE 0e0 END END)')} AS far,
 {s6('avg(CASE WHEN label = 1 THEN CASE WHEN score < t THEN 1e0 ELSE 0e0 END END)')} AS miss
 FROM dev d JOIN best b ON d.model = b.model GROUP BY d.model""",
)
def k11_unseen_transfer(spark, sf):
    """Choice and cutoffs from out-of-fold scores, error rates on unseen clips."""
    scores = long_scores(spark, sf)
    out = unseen.transferred(scores.where("corpus <> 'a'"), scores.where("corpus = 'a'"), ["secondary", "primary"])
    return out.select("model", "chosen", *[r6(c).alias(c) for c in ("oof_min_dcf", "cutoff", "far", "miss")])


@catalog.add(
    "k11_attack_recall",
    with_(*TRANSFER)
    + f""" SELECT grp, d.model, count(*) AS spoofs, {s6('avg(CASE WHEN score >= t THEN 1e0 ELSE 0e0 END)')} AS recall
 FROM dev d JOIN best b ON d.model = b.model WHERE label = 1 GROUP BY grp, d.model""",
)
def k11_attack_recall(spark, sf):
    scores = long_scores(spark, sf)
    out = unseen.attack_recall(scores.where("corpus <> 'a'"), scores.where("corpus = 'a'"))
    return out.select("grp", "model", "spoofs", r6("recall").alias("recall"))


# Members of the registry and the blends read from their scores.
MEMBERS = (
    Mo.Spec("logistic_full", "logistic", "base_lfcc", 0.1),
    Mo.Spec("logistic_cost", "logistic", "base_lfcc", 0.1, "cost"),
    Mo.Spec("logistic_temporal", "logistic", "temporal", 0.1),
    Mo.Spec("logistic_base", "logistic", "base", 0.1),
)
BLENDS = {
    "full_and_temporal": {"logistic_full": 0.75, "logistic_temporal": 0.25},
    "equal": {"logistic_cost": 0.5, "logistic_base": 0.5},
}
FOLDS = 5


def makers_of(specs):
    return {s.name: Mo.Maker(s) for s in specs}


def registry(spark, sf, specs):
    """Every fourth clip is unseen; the others are in five group folds."""
    data = three_views(rows(spark, sf))
    train = data.where("clip_id % 4 <> 0")
    folds = splits.stratified_group_folds(train, "label", "grp", FOLDS, 42).select("grp", "fold")
    return Rg.build(train, folds, FOLDS, makers_of(specs), Mo.shared_path(spark), data.where("clip_id % 4 = 0"))


VECTORS = """vectors AS (SELECT vec_id AS clip_id, CAST(label >= 5 AS INT) AS label,
 CASE WHEN label < 5 THEN concat('real:', CAST(vec_id % 12 AS VARCHAR)) ELSE concat('synthetic:', CAST(label % 4 AS VARCHAR)) END AS grp FROM embeddings)"""


@catalog.add(
    "k10_registry_counts",
    recursive(
        VECTORS,
        "fit AS (SELECT * FROM vectors WHERE clip_id % 4 <> 0)",
        counts_sql("fit", "counts", "CAST(0 AS INT)", "md5(concat('42:', grp))"),
        share_sql("counts", FOLDS, "walk"),
        "placed AS (SELECT label, fold FROM fit f JOIN walk w ON f.grp = w.grp WHERE w.i > 0 UNION ALL SELECT label, -1 FROM vectors WHERE clip_id % 4 = 0)",
    )
    + f""" SELECT model, fold, label, count(*) AS clips, count(*) AS scores_in_range
 FROM placed, (VALUES {", ".join(f"('{n}')" for n in [*[s.name for s in MEMBERS], *BLENDS])}) m(model) GROUP BY model, fold, label""",
)
def k10_registry_counts(spark, sf):
    """Four models and two blends of them: clips of each class that have a probability, per fold and for unseen clips."""
    scores = Rg.with_blends(registry(spark, sf, MEMBERS).scores(spark), BLENDS)
    return scores.groupBy("model", "fold", "label").agg(
        F.count_distinct("clip_id").alias("clips"), F.count_if(F.col("score").between(0, 1)).alias("scores_in_range")
    )


def pair_sql(rows_: str) -> str:
    return f"""wgrid AS (SELECT ofold, label, m, t AS tw, round(t*secondary_score + (1e0-t)*CASE WHEN status = 'consistent' THEN primary_score*(1e0-m) ELSE primary_score END, 12) AS score
 FROM {rows_}, (VALUES (0e0), (25e-3), (5e-2), (75e-3), (1e-1)) a(m), (VALUES (0e0), (25e-2), (5e-1), (75e-2), (1e0)) b(t))"""


NESTED = (
    views.SCORED,
    counts_sql("scored", "counts", "CAST(0 AS INT)", "md5(concat('2026:', grp))"),
    share_sql("counts", 5, "walk"),
    "placed AS (SELECT s.*, w.fold FROM scored s JOIN walk w ON s.grp = w.grp WHERE w.i > 0)",
    "inner_rows AS (SELECT p.*, o AS ofold FROM placed p, range(0, 5) r(o) WHERE p.fold <> o)",
    pair_sql("inner_rows"),
    curve_sql("ofold, m, tw", "wgrid"),
    """weights AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ofold ORDER BY cost, abs(tw - 5e-1), abs(m - 5e-2), m, tw) AS place
 FROM best) q WHERE place = 1)""",
)


def outer_rows(spark, sf):
    """Given scores as the components: (training sides per outer fold, outer folds)."""
    clips = views.scored(spark, sf)
    folds = splits.stratified_group_folds(clips, "label", "grp", 5, fusion.OUTER_SEED).select("grp", "fold")
    placed = clips.join(folds, "grp").select(
        "clip_id", "label", "status", "fold", F.col("primary_score").alias("base"), F.col("secondary_score").alias("temporal")
    )
    train = placed.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("outer <> fold")
    return train, placed.withColumn("outer", F.col("fold"))


@catalog.add(
    "k17_nested_weights",
    recursive(*NESTED) + f' SELECT CAST(ofold AS INT) AS "outer", tw AS temporal_weight, m AS metadata_weight, {s6("cost")} AS cost FROM weights',
)
def k17_nested_weights(spark, sf):
    """Blend weights of every outer fold from its training side alone, in one job."""
    weights, _ = fusion.nested_systems(*outer_rows(spark, sf))
    return weights.withColumn("cost", r6("cost"))


SYSTEMS = """fused AS (SELECT p.*, w.tw, w.m AS mw, CASE WHEN status = 'consistent' THEN primary_score*(1e0-5e-2) ELSE primary_score END AS usual,
 CASE WHEN status = 'consistent' THEN primary_score*(1e0-w.m) ELSE primary_score END AS pulled FROM placed p JOIN weights w ON p.fold = w.ofold),
sys AS (SELECT 'baseline' AS model, label, round(primary_score, 12) AS score FROM fused UNION ALL SELECT 'container', label, round(usual, 12) FROM fused
 UNION ALL SELECT 'temporal', label, round(secondary_score, 12) FROM fused UNION ALL SELECT 'nested_fusion', label, round(tw*secondary_score + (1e0-tw)*pulled, 12) FROM fused
 UNION ALL SELECT 'fixed_fusion', label, round(5e-1*usual + 5e-1*secondary_score, 12) FROM fused)"""


@catalog.add(
    "k17_nested_systems",
    # The second curve takes names of its own.
    recursive(
        *NESTED,
        SYSTEMS,
        curve_sql("model", "sys").replace("pts AS", "spts AS").replace("FROM pts", "FROM spts").replace("cum AS", "scum AS").replace("FROM cum", "FROM scum")
        .replace("cand AS", "scand AS").replace("FROM cand", "FROM scand").replace("costed AS", "scosted AS").replace("FROM costed", "FROM scosted")
        .replace("best AS", "sbest AS").replace("roc AS", "sroc AS").replace("FROM roc", "FROM sroc").replace("eer AS", "seer AS"),
        AUC_SQL.replace("FROM long", "FROM sys"),
    )
    + f""" SELECT b.model AS system, {s6('cost')} AS min_dcf, {s6('t')} AS threshold, {s6('auc')} AS auc
 FROM sbest b JOIN auc a ON a.model = b.model""",
)
def k17_nested_systems(spark, sf):
    """Five systems pooled over outer folds that neither their components nor their weights have seen."""
    _, systems = fusion.nested_systems(*outer_rows(spark, sf))
    out = fusion.report(systems).where("outer = -1")
    return out.select("system", *[r6(c).alias(c) for c in ("min_dcf", "threshold", "auc")])


@catalog.add("k17_nested_fusion")
def k17_nested_fusion(spark, sf):
    """Two fitted components, five outer and three inner folds: metrics of five systems per outer fold and pooled."""
    status = F.when(F.col("clip_id") % 5 < 3, "consistent").otherwise("inconsistent")
    data = three_views(rows(spark, sf)).withColumn("status", status)
    makers = makers_of([Mo.Spec("base", "logistic", "base", 0.1), Mo.Spec("temporal", "logistic", "temporal", 0.1)])
    scores = fusion.cross_scores(data, makers, Mo.shared_path(spark))
    both = fusion.paired(scores, data, "base", "temporal")
    _, systems = fusion.nested_systems(both.where(F.col("fold") != Rg.ALL), both.where(F.col("fold") == Rg.ALL))
    return fusion.report(systems).select("system", "outer", *[r6(c).alias(c) for c in ("min_dcf", "auc", "eer")])


@catalog.add("k11_select_to_unseen")
def k11_select_to_unseen(spark, sf):
    """Members and blends ranked out of fold; their own cutoffs, and the two policies of the best pair, on unseen clips."""
    made = registry(spark, sf, MEMBERS)
    oof, new = (Rg.with_blends(s, BLENDS) for s in (made.out_of_fold(spark), made.unseen(spark)))
    listed = [*[s.name for s in MEMBERS], *BLENDS]
    models = unseen.transferred(oof, new, listed, [s.name for s in MEMBERS if s.view == "base_lfcc"])
    quality = rows(spark, sf).select("clip_id", F.slice("v", 1, 12).alias("quality"))
    pair = unseen.best_pair(oof, listed)
    policies = unseen.pair_policies(oof, new, quality, pair).select(F.col("policy").alias("model"), F.col("min_dcf").alias("unseen_dcf"))
    return models.unionByName(policies, allowMissingColumns=True).select(
        "model", "chosen", *[r6(c).alias(c) for c in ("oof_min_dcf", "cutoff", "unseen_dcf", "far", "miss")]
    )


@catalog.add("j11_expansion_models")
def j11_expansion_models(spark, sf):
    """One model on three training corpora, the same five held-out folds, scored on the old clips."""
    data = rows(spark, sf)
    folds = splits.stratified_group_folds(data, "label", "grp", FOLDS, 42).select("grp", "fold")
    maker = Mo.Maker(Mo.Spec("logistic", "logistic", c=0.1))
    out = compare.corpus_expansion(data.where("clip_id % 2 = 0"), data.where("clip_id % 2 = 1"), folds, FOLDS, maker, Mo.shared_path(spark))
    return out.select("training", "fold", *[r6(c).alias(c) for c in ("min_dcf", "auc", "eer")])


def renamed(sql: str, suffix: str) -> str:
    """A second curve in one statement, under names of its own."""
    return re.sub(r"\b(pts|cum|cand|costed|best|roc|eer)\b(?=[\s,)]|$)", lambda m: m[1] + suffix, sql)


HOLDOUTS = (
    "grouped AS (SELECT *, 'g' || CAST(clip_id % 20 AS VARCHAR) AS grp FROM rows)",
    "gt AS (SELECT grp, sum(1-label) AS real, sum(label) AS spoof FROM grouped GROUP BY grp)",
    """drawn AS (SELECT seed, grp, real, spoof, row_number() OVER (PARTITION BY seed ORDER BY md5(concat(CAST(seed AS VARCHAR), ':', grp)), grp)
 <= (SELECT CAST(ceil(count(*)*25e-2) AS BIGINT) FROM gt) AS held FROM gt, range(73, 78) r(seed))""",
    """ok AS (SELECT seed FROM drawn GROUP BY seed HAVING sum(CASE WHEN held THEN real ELSE 0 END) > 0 AND sum(CASE WHEN held THEN spoof ELSE 0 END) > 0
 AND sum(CASE WHEN held THEN 0 ELSE real END) > 0 AND sum(CASE WHEN held THEN 0 ELSE spoof END) > 0)""",
    """parts AS (SELECT CAST(d.seed - 73 AS INT) AS fold, d.held, g.* FROM grouped g JOIN drawn d ON g.grp = d.grp JOIN ok ON ok.seed = d.seed
 UNION ALL SELECT -1, false, g.* FROM grouped g)""",
    """cgrid AS (SELECT fold, scope, label, i/2e1 AS alpha, round(i/2e1*a + (1e0 - i/2e1)*b, 12) AS score
 FROM (SELECT fold, cluster AS scope, label, a, b FROM parts WHERE NOT held UNION ALL SELECT fold, -1, label, a, b FROM parts WHERE NOT held) q, range(0, 21) g(i))""",
    curve_sql("fold, scope, alpha", "cgrid").replace("nr-rb)*1e0/nr", "nr-rb)*1e0/nullif(nr, 0)").replace("pb*1e0/np", "pb*1e0/nullif(np, 0)"),
    """chosen AS (SELECT fold, scope, alpha FROM (SELECT *, row_number() OVER (PARTITION BY fold, scope ORDER BY cost, alpha) AS r FROM best
 WHERE cost IS NOT NULL) q WHERE r = 1)""",
    """weights AS (SELECT f.fold, f.cluster, size, size >= 40 AND both_classes AS own,
 CASE WHEN size >= 40 AND both_classes THEN c.alpha ELSE o.alpha END AS alpha, o.alpha AS overall
 FROM (SELECT fold, cluster, count(*) AS size, min(label) <> max(label) AS both_classes FROM parts WHERE NOT held GROUP BY fold, cluster) f
 LEFT JOIN chosen c ON f.fold = c.fold AND f.cluster = c.scope JOIN chosen o ON o.fold = f.fold AND o.scope = -1)""",
)


@catalog.add(
    "k20_holdout_weights",
    with_(views.SPECTRA, ROWS, *HOLDOUTS) + f" SELECT fold, CAST(cluster AS INT) AS cluster, size, own, {s6('alpha')} AS alpha, {s6('overall')} AS overall FROM weights",
)
def k20_holdout_weights(spark, sf):
    """Weights of a supplied partition on the training side of every group holdout and on all rows (-1)."""
    out = holdout_routing.weights(supplied(spark, sf).where("NOT held"), "a", "b")
    return out.withColumn("alpha", r6("alpha")).withColumn("overall", r6("overall"))


@catalog.add(
    "k21_holdout_routing",
    with_(
        views.SPECTRA,
        ROWS,
        *HOLDOUTS,
        "overalls AS (SELECT fold, max(overall) AS overall FROM weights GROUP BY fold)",
        "tested AS (SELECT p.*, o.overall, coalesce(w.alpha, o.overall) AS alpha FROM parts p JOIN overalls o ON o.fold = p.fold"
        " LEFT JOIN weights w ON w.fold = p.fold AND w.cluster = p.cluster WHERE held)",
        """pol AS (SELECT fold, 'overall' AS policy, label, round(overall*a + (1e0-overall)*b, 12) AS score FROM tested
 UNION ALL SELECT fold, 'conditional', label, round(alpha*a + (1e0-alpha)*b, 12) FROM tested)""",
        renamed(curve_sql("fold, policy", "pol"), "2"),
        "per AS (SELECT b.fold, max(overall) AS alpha, max(CASE WHEN policy = 'overall' THEN cost END) AS o,"
        " max(CASE WHEN policy = 'conditional' THEN cost END) AS c FROM best2 b JOIN overalls v ON v.fold = b.fold GROUP BY b.fold)",
    )
    + f" SELECT fold, {s6('alpha')} AS alpha, {s6('o')} AS overall_dcf, {s6('c')} AS conditional_dcf FROM per"
    f" UNION ALL SELECT CAST(NULL AS INT), CAST(NULL AS DOUBLE), {s6('avg(o)')}, {s6('avg(c)')} FROM per",
)
def k21_holdout_routing(spark, sf):
    """A supplied partition on five random group holdouts: cost of the overall and the cluster-wise blend, and their means."""
    parts = supplied(spark, sf)
    table = holdout_routing.weights(parts.where("NOT held"), "a", "b")
    out = holdout_routing.report(holdout_routing.policies(parts.where("held"), table, "a", "b"), table)
    return out.select("fold", *[r6(c).alias(c) for c in ("alpha", "overall_dcf", "conditional_dcf")])


def supplied(spark, sf):
    data = routed_rows(spark, sf).withColumn("grp", F.concat(F.lit("g"), (F.col("clip_id") % 20).cast("string")))
    return holdout_routing.by_holdout(holdout_routing.roles(data)).withColumn("cluster", F.col("cluster").cast("int"))


@catalog.add("k19_holdout_routing")
def k19_holdout_routing(spark, sf):
    """Scaler, clusters and weights fitted on the training groups of five holdouts, all in the same passes; costs on held groups."""
    data = conditions(spark, sf).withColumn("grp", F.concat("grp", F.lit("/"), (F.col("clip_id") % 5).cast("string")))
    out, _ = holdout_routing.evaluate(data, "quality", "a", "b")
    return out.select("fold", *[r6(c).alias(c) for c in ("alpha", "overall_dcf", "conditional_dcf")])
