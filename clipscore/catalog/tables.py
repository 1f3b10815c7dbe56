"""Projection, join, aggregation and set queries (B, F, G, L) over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipscore import views
from clipscore.catalog.common import Catalog, r6, s6, with_
from clipscore.catalog.metrics import LONG, curve_sql, long_scores
from clipscore.functions import scores as S
from clipscore.functions import vectors as V
from clipscore.operators import comparison, grouping, joins
from clipscore.operators import metrics as M
from clipscore.sources import manifest as Mf

catalog = Catalog()


# -- B: projections and scalar expressions ------------------------------------------------------


@catalog.add(
    "b1_feature_slices",
    with_(views.SPECTRA)
    + f""" SELECT clip_id, part, pos, {s6('value')} AS value FROM (
 SELECT clip_id, 'header' AS part, CAST(generate_subscripts(mag[1:7], 1) - 1 AS INT) AS pos, unnest(mag[1:7]) AS value FROM spectra
 UNION ALL SELECT clip_id, 'signal', CAST(generate_subscripts(mag[8:14], 1) - 1 AS INT), unnest(mag[8:14]) FROM spectra
 UNION ALL SELECT clip_id, 'even', CAST(generate_subscripts(e, 1) - 1 AS INT), unnest(e) FROM
  (SELECT clip_id, [mag[1], mag[3], mag[5], mag[7]] AS e FROM spectra) q)""",
)
def b1_feature_slices(spark, sf):
    """Encoding header and signal columns, and a selection by name."""
    names = tuple(f"{'keep' if i % 2 == 0 else 'drop'}_{i}" for i in range(8))
    mag = F.col("mag")
    parts = F.create_map(
        F.lit("header"), V.header_part(mag),
        F.lit("signal"), V.signal_part(mag),
        F.lit("even"), V.pick_by_name(mag, names, lambda n: n.startswith("keep")),
    )
    rows = views.spectra(spark, sf).select("clip_id", F.explode(parts).alias("part", "v"))
    return rows.select("clip_id", "part", F.posexplode("v").alias("pos", "value")).withColumn(
        "value", r6("value")
    )


@catalog.add(
    "b2_view_concat",
    with_(views.SPECTRA)
    + f""" SELECT clip_id, len(mag) AS width, {s6('list_sum(mag)')} AS total,
 {s6('list_sum(list_transform(mag, lambda v, i: v * i))')} AS weighted FROM spectra""",
)
def b2_view_concat(spark, sf):
    """Two views joined on the clip id and concatenated in order."""
    rows = views.spectra(spark, sf)
    base = rows.select("clip_id", F.slice("mag", 1, 40).alias("base"))
    lfcc = rows.select("clip_id", F.slice("mag", 41, 24).alias("lfcc"))
    both = joins.concat_views(base, lfcc, "base", "lfcc", "v")
    index = F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: i.cast("double"))
    return both.select(
        "clip_id",
        F.size("v").cast("long").alias("width"),
        r6(V.total(F.col("v"))).alias("total"),
        r6(V.dot(F.col("v"), index)).alias("weighted"),
    )


@catalog.add(
    "b3_vector_guard",
    with_(views.SPECTRA)
    + """ SELECT clip_id, NOT (clip_id % 7 = 0 OR clip_id % 11 = 0 OR clip_id % 13 = 0) AS sound FROM spectra""",
)
def b3_vector_guard(spark, sf):
    """Planted faults: NaN, infinity, and a missing element."""
    i = F.col("clip_id")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    v = F.when(i % 7 == 0, F.concat(F.slice("mag", 1, 63), F.array(nan)))
    v = v.when(i % 11 == 0, F.concat(F.slice("mag", 1, 63), F.array(-inf)))
    v = v.when(i % 13 == 0, F.slice("mag", 1, 63)).otherwise(F.col("mag"))
    return views.spectra(spark, sf).select("clip_id", V.is_sound(v, 64).alias("sound"))


@catalog.add(
    "b4_container_prior",
    with_(views.SCORED)
    + f""" SELECT clip_id, {s6("CASE WHEN status = 'consistent' THEN primary_score * (1e0 - 5e-2) ELSE primary_score END")} AS score FROM scored""",
)
def b4_container_prior(spark, sf):
    out = S.container_adjusted(F.col("primary_score"), F.col("status"))
    return views.scored(spark, sf).select("clip_id", r6(out).alias("score"))


@catalog.add(
    "b5_blends",
    with_(views.SCORED)
    + f""" SELECT clip_id, {s6('75e-2*primary_score + 25e-2*secondary_score')} AS weighted,
 {s6("greatest(0e0, least(1e0, 6e-1*(CASE WHEN status = 'consistent' THEN primary_score*(1e0-1e-1) ELSE primary_score END) + 4e-1*secondary_score))")} AS fused,
 {s6('(primary_score + secondary_score)/2e0')} AS mean2 FROM scored""",
)
def b5_blends(spark, sf):
    a, b = F.col("primary_score"), F.col("secondary_score")
    fused = S.mix(0.6, S.container_adjusted(a, F.col("status"), 0.1), b)
    return views.scored(spark, sf).select(
        "clip_id",
        r6(S.blend([(0.75, a), (0.25, b)])).alias("weighted"),
        r6(fused).alias("fused"),
        r6(S.blend([(0.5, a), (0.5, b)])).alias("mean2"),
    )


@catalog.add(
    "b6_fallback_rule",
    with_(views.SCORED)
    + f""" SELECT clip_id, {s6('''CASE WHEN clip_id % 3 = 0 THEN primary_score WHEN clip_id % 3 = 1 THEN 5e-1*primary_score + 5e-1*secondary_score
 ELSE 8e-1*primary_score + 2e-1*secondary_score END''')} AS score FROM scored""",
)
def b6_fallback_rule(spark, sf):
    rows = views.scored(spark, sf)
    second = rows.where("clip_id % 3 <> 0").select("clip_id", F.col("secondary_score").alias("b"))
    alpha = F.when(F.col("clip_id") % 3 == 2, 0.8)
    return rows.join(second, "clip_id", "left").select(
        "clip_id", r6(S.fallback_score(F.col("primary_score"), F.col("b"), alpha)).alias("score")
    )


@catalog.add(
    "b7_decision",
    with_(views.SCORED)
    + " SELECT clip_id, primary_score >= 5e-1 AS synthetic FROM scored",
)
def b7_decision(spark, sf):
    return views.scored(spark, sf).select("clip_id", (F.col("primary_score") >= 0.5).alias("synthetic"))


@catalog.add(
    "b8_row_weights",
    with_(views.SCORED)
    + f""", c AS (SELECT count(*)*1e0 AS n, sum(label)*1e0 AS ns, sum(1-label)*1e0 AS nr FROM scored)
 SELECT clip_id, {s6('CASE WHEN label = 1 THEN n/(2e0*ns) ELSE n/(2e0*nr) END')} AS balanced,
 {s6('CASE WHEN label = 1 THEN 1e0 ELSE (28e-1/nr)/(3e-1/ns) END')} AS cost_weight FROM scored, c""",
)
def b8_row_weights(spark, sf):
    rows = joins.with_class_weights(views.scored(spark, sf))
    return rows.select("clip_id", r6("balanced").alias("balanced"), r6("cost_weight").alias("cost_weight"))


BUNDLE = """CASE clip_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'version' WHEN 2 THEN 'kind' WHEN 3 THEN 'names' ELSE 'weight' END"""


@catalog.add(
    "b9_bundle_check",
    with_(views.SCORED) + f" SELECT {BUNDLE} AS verdict, count(*) AS n FROM scored GROUP BY 1",
)
def b9_bundle_check(spark, sf):
    """Policy rows with one planted fault each, checked against the expected bundle."""
    i = F.col("clip_id") % 5
    rows = views.scored(spark, sf).select(
        F.when(i == 1, 1).otherwise(2).alias("version"),
        F.when(i == 2, "other").otherwise("base").alias("kind"),
        F.when(i == 3, F.array(*map(F.lit, V.BASE[:83])))
        .otherwise(F.array(*map(F.lit, V.BASE)))
        .alias("feature_names"),
        F.when(i == 4, 1.5).otherwise(0.05).alias("metadata_real_weight"),
    )
    verdict = joins.bundle_verdict(2, "base", V.BASE)
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@catalog.add(
    "b10_string_scalars",
    with_(views.CONTAINERS)
    + """ SELECT clip_id, list_extract(string_split(path, '/'), -1) AS filename, lower(regexp_extract(list_extract(string_split(path, '/'), -1), '([.][^.]+)$', 1)) AS suffix,
 list_extract(string_split(path, ':'), -1) AS last_part, list_extract(string_split(path, ':'), 1) AS scheme,
 path LIKE 'https%' AS secure, path LIKE '%example%' AS has_example, regexp_full_match(suffix, '[a-z0-9]+') AS plain_suffix FROM containers""",
)
def b10_string_scalars(spark, sf):
    path = F.col("path")
    return views.containers(spark, sf).select(
        "clip_id",
        S.basename(path).alias("filename"),
        S.suffix(path).alias("suffix"),
        S.last_part(path).alias("last_part"),
        F.get(F.split(path, ":"), 0).alias("scheme"),
        path.startswith("https").alias("secure"),
        path.contains("example").alias("has_example"),
        F.col("suffix").rlike("^[a-z0-9]+$").alias("plain_suffix"),
    )


@catalog.add(
    "b11_math_scalars",
    with_(views.SPECTRA)
    + f""" SELECT clip_id, {s6('ln(greatest(mag[1], 1e-10))')} AS ln_v, {s6('ln(1e0 + mag[2])')} AS log1p_v, {s6('sqrt(mag[3])')} AS sqrt_v,
 {s6('greatest(2e-2, least(1e-1, mag[4]))')} AS clipped, {s6('round_even(mag[5]*100, 0)')} AS rint_v,
 {s6('list_median(mag)')} AS median_v,
 CAST(len(list_filter(range(1, 65), lambda i: list_sum(mag[1:i]) < 5e-1 * list_sum(mag))) AS INT) AS half_index FROM spectra""",
)
def b11_math_scalars(spark, sf):
    m = [F.get("mag", i) for i in range(5)]
    cum = grouping.running_array(F.col("mag"))
    middle = F.slice(F.array_sort("mag"), 32, 2)
    return views.spectra(spark, sf).select(
        "clip_id",
        r6(F.ln(F.greatest(m[0], F.lit(1e-10)))).alias("ln_v"),
        r6(F.log1p(m[1])).alias("log1p_v"),
        r6(F.sqrt(m[2])).alias("sqrt_v"),
        r6(F.greatest(F.lit(0.02), F.least(F.lit(0.1), m[3]))).alias("clipped"),
        r6(F.rint(m[4] * 100)).alias("rint_v"),
        r6((F.get(middle, 0) + F.get(middle, 1)) / 2).alias("median_v"),
        F.size(F.filter(cum, lambda c: c < 0.5 * V.total(F.col("mag")))).alias("half_index"),
    )


# -- F: joins ------------------------------------------------------------------------------------

SIDES = """tr AS (SELECT clip_id, grp FROM scored WHERE clip_id % 3 <> 0), te AS (SELECT clip_id, grp FROM scored WHERE clip_id % 4 = 0)"""


@catalog.add(
    "f1_leakage",
    with_(views.SCORED, SIDES)
    + """ SELECT 'file' AS kind, CAST(clip_id AS VARCHAR) AS item FROM te WHERE clip_id IN (SELECT clip_id FROM tr)
 UNION ALL SELECT DISTINCT 'group', grp FROM te WHERE grp IN (SELECT grp FROM tr)""",
)
def f1_leakage(spark, sf):
    rows = views.scored(spark, sf)
    return joins.leakage(rows.where("clip_id % 3 <> 0"), rows.where("clip_id % 4 = 0"), "clip_id", "grp")


@catalog.add(
    "f2_exact_match",
    with_(views.SCORED)
    + """ SELECT CAST(clip_id AS VARCHAR) AS item, CASE WHEN clip_id % 6 = 0 THEN 'only left' ELSE 'only right' END AS reason FROM scored
 WHERE (clip_id % 6 = 0) <> (clip_id % 10 = 0)""",
)
def f2_exact_match(spark, sf):
    ids = views.scored(spark, sf).select("clip_id")
    return Mf.name_mismatches(
        ids.where("clip_id % 10 <> 0"), ids.where("clip_id % 6 <> 0"), "clip_id"
    )


@catalog.add(
    "f3_score_alignment",
    with_(views.SCORED)
    + f" SELECT clip_id, {s6('primary_score')} AS a, {s6('secondary_score')} AS b FROM scored",
)
def f3_score_alignment(spark, sf):
    rows = views.scored(spark, sf)
    first = rows.select("clip_id", F.col("primary_score").alias("a"))
    second = rows.select("clip_id", F.col("secondary_score").alias("b"))
    return first.join(second, "clip_id").select("clip_id", r6("a").alias("a"), r6("b").alias("b"))


@catalog.add(
    "f4_protocol_listing",
    with_(views.SCORED)
    + " SELECT label, count(*) AS present FROM scored WHERE clip_id % 5 <> 0 GROUP BY label",
)
def f4_protocol_listing(spark, sf):
    rows = views.scored(spark, sf)
    listed = rows.where("clip_id % 5 <> 0").select("clip_id")
    return rows.join(listed, "clip_id").groupBy("label").agg(F.count("*").alias("present"))


@catalog.add(
    "f5_recorded_holdout",
    with_(
        views.SCORED,
        "held AS (SELECT DISTINCT grp FROM scored WHERE length(grp) % 2 = 0 UNION ALL SELECT 'real:nowhere' UNION ALL SELECT 'synthetic:gone')",
    )
    + """ SELECT grp, count(*) AS clips, false AS missing FROM scored WHERE grp IN (SELECT grp FROM held) GROUP BY grp
 UNION ALL SELECT grp, 0, true FROM held WHERE grp NOT IN (SELECT grp FROM scored)""",
)
def f5_recorded_holdout(spark, sf):
    rows = views.scored(spark, sf)
    absent = spark.createDataFrame([("real:nowhere",), ("synthetic:gone",)], "grp string")
    held = rows.where(F.length("grp") % 2 == 0).select("grp").distinct().unionByName(absent)
    return joins.holdout_groups(rows, held, "grp")


@catalog.add(
    "f6_expanded_training",
    with_(
        views.SCORED,
        "held AS (SELECT DISTINCT grp FROM scored WHERE length(grp) % 2 = 0)",
    )
    + """ SELECT corpus, grp, count(*) AS clips FROM (
 SELECT 'old' AS corpus, grp FROM scored WHERE clip_id % 2 = 0 AND grp NOT IN (SELECT grp FROM held)
 UNION ALL SELECT 'new', grp FROM scored WHERE clip_id % 2 = 1 AND grp LIKE 'real:%' AND grp NOT IN (SELECT grp FROM held)) q GROUP BY corpus, grp""",
)
def f6_expanded_training(spark, sf):
    rows = views.scored(spark, sf)
    held = rows.where(F.length("grp") % 2 == 0).select("grp").distinct()
    out = joins.expanded_training(
        rows.where("clip_id % 2 = 0"), rows.where("clip_id % 2 = 1"), held, "grp", "real:"
    )
    return out.groupBy("corpus", "grp").agg(F.count("*").alias("clips"))


@catalog.add(
    "f7_score_status",
    with_(views.SCORED)
    + f""" SELECT status, count(*) AS n, {s6("avg(CASE WHEN status = 'consistent' THEN primary_score*(1e0-5e-2) ELSE primary_score END)")} AS mean_score FROM scored GROUP BY status""",
)
def f7_score_status(spark, sf):
    rows = views.scored(spark, sf)
    scores, status = rows.select("clip_id", "primary_score"), rows.select("clip_id", "status")
    adjusted = S.container_adjusted(F.col("primary_score"), F.col("status"))
    return (
        scores.join(status, "clip_id")
        .groupBy("status")
        .agg(F.count("*").alias("n"), r6(F.avg(adjusted)).alias("mean_score"))
    )


# -- G: aggregations -----------------------------------------------------------------------------


@catalog.add(
    "g1_class_status_counts",
    with_(views.SCORED)
    + """ SELECT label, count(*) AS clips, count(*) FILTER (status = 'consistent') AS consistent,
 count(*) FILTER (status = 'inconsistent') AS inconsistent FROM scored GROUP BY label""",
)
def g1_class_status_counts(spark, sf):
    return views.scored(spark, sf).groupBy("label").agg(
        F.count("*").alias("clips"),
        F.count_if(F.col("status") == "consistent").alias("consistent"),
        F.count_if(F.col("status") == "inconsistent").alias("inconsistent"),
    )


@catalog.add(
    "g2_generator_counts",
    with_(views.SCORED)
    + """ SELECT grp AS generator, count(*) AS available, count(*) FILTER (clip_id % 3 = 0) AS selected,
 count(*) FILTER (status = 'unknown') AS ignored FROM scored WHERE label = 1 GROUP BY grp""",
)
def g2_generator_counts(spark, sf):
    rows = views.scored(spark, sf).where("label = 1")
    return grouping.selection_counts(rows, "grp", F.col("clip_id") % 3 == 0, F.col("status") == "unknown")


@catalog.add(
    "g3_group_facts",
    with_(views.SCORED)
    + """ SELECT count(DISTINCT grp) AS groups, count(DISTINCT CASE WHEN grp LIKE 'real:%' THEN grp END) AS real_groups,
 string_agg(DISTINCT CASE WHEN label = 1 THEN list_extract(string_split(grp, ':'), -1) END, ',' ORDER BY CASE WHEN label = 1 THEN list_extract(string_split(grp, ':'), -1) END) AS families FROM scored""",
)
def g3_group_facts(spark, sf):
    return grouping.group_facts(views.scored(spark, sf), "grp", "real:", "synthetic:")


CONFUSION = """cm AS (SELECT model, count(*) FILTER (label = 0 AND score < 5e-1) AS tn, count(*) FILTER (label = 0 AND score >= 5e-1) AS fp,
 count(*) FILTER (label = 1 AND score < 5e-1) AS fn, count(*) FILTER (label = 1 AND score >= 5e-1) AS tp FROM long GROUP BY model)"""


@catalog.add(
    "g4_confusion", with_(views.SCORED, LONG, CONFUSION) + " SELECT model, tn, fp, fn, tp FROM cm"
)
def g4_confusion(spark, sf):
    return M.confusion(long_scores(spark, sf), ["model"]).select("model", "tn", "fp", "fn", "tp")


@catalog.add(
    "g5_accuracy",
    with_(views.SCORED, LONG, CONFUSION)
    + f""" SELECT model, {s6('(tn+tp)*1e0/(tn+fp+fn+tp)')} AS accuracy, {s6('(tp*1e0/(tp+fn) + tn*1e0/(tn+fp))/2e0')} AS balanced_accuracy FROM cm""",
)
def g5_accuracy(spark, sf):
    out = M.confusion(long_scores(spark, sf), ["model"])
    return out.select(
        "model", r6("accuracy").alias("accuracy"), r6("balanced_accuracy").alias("balanced_accuracy")
    )


@catalog.add(
    "g6_recall_per_attack",
    with_(views.SCORED, LONG, curve_sql("model"))
    + f""" SELECT l.model, l.grp, count(*) AS examples, {s6('avg(CASE WHEN accept_all = 0 AND score >= t THEN 1e0 ELSE 0e0 END)')} AS recall
 FROM long l JOIN best b ON l.model = b.model WHERE label = 1 GROUP BY l.model, l.grp""",
)
def g6_recall_per_attack(spark, sf):
    rows = long_scores(spark, sf)
    cuts = M.min_dcf(rows, ["model"]).select("model", "threshold")
    return grouping.recall_per_group(rows, cuts, ["model"], "grp").withColumn("recall", r6("recall"))


@catalog.add(
    "g7_metrics_per_corpus",
    with_(views.SCORED, LONG, curve_sql("corpus, model"))
    + f""" SELECT corpus, model, {s6('cost')} AS min_dcf, {s6('fa')} AS far FROM best""",
)
def g7_metrics_per_corpus(spark, sf):
    out = M.summary(long_scores(spark, sf), ["corpus", "model"])
    return out.select("corpus", "model", r6("min_dcf").alias("min_dcf"), r6("far").alias("far"))


@catalog.add(
    "g8_header_medians",
    with_(views.SCORED)
    + f""" SELECT label, {s6('median(primary_score)')} AS median_a, {s6('median(secondary_score)')} AS median_b FROM scored GROUP BY label""",
)
def g8_header_medians(spark, sf):
    rows = views.scored(spark, sf)
    out = grouping.medians(rows, ["label"], {"median_a": "primary_score", "median_b": "secondary_score"})
    return out.select("label", r6("median_a").alias("median_a"), r6("median_b").alias("median_b"))


FOREST_GRID = """grid AS (SELECT clip_id, label, clip_id % 3 AS fold, w, round(w*primary_score + (1e0-w)*secondary_score, 12) AS score
 FROM scored, (VALUES (0e0), (25e-2), (5e-1), (75e-2), (1e0)) AS ws(w))"""


@catalog.add(
    "g9_weight_sweep",
    with_(
        views.SCORED,
        FOREST_GRID,
        """ranks AS (SELECT w, fold, label, rank() OVER (PARTITION BY w, fold ORDER BY score)
 + (count(*) OVER (PARTITION BY w, fold, score) - 1) / 2e0 AS rk FROM grid)""",
        """aucs AS (SELECT w, fold, (sum(CASE WHEN label = 1 THEN rk ELSE 0e0 END) - sum(label)*(sum(label)+1)/2e0)
 / (sum(label)*1e0*sum(1-label)) AS auc FROM ranks GROUP BY w, fold)""",
    )
    + f" SELECT w AS weight, {s6('avg(auc)')} AS mean_auc, {s6('min(auc)')} AS worst_auc FROM aucs GROUP BY w",
)
def g9_weight_sweep(spark, sf):
    rows = views.scored(spark, sf).withColumn("fold", F.col("clip_id") % 3)
    out = comparison.weight_sweep(
        rows, ["fold"], "primary_score", "secondary_score", [0.0, 0.25, 0.5, 0.75, 1.0]
    )
    return out.select("weight", r6("mean_auc").alias("mean_auc"), r6("worst_auc").alias("worst_auc"))


PARTED = """parted AS (SELECT model, CAST(p AS INT) AS partition, label,
 round(CASE WHEN (clip_id * (p + 1)) % 7 = 0 THEN score * 9e-1 ELSE score END, 12) AS score FROM long, range(0, 3) r(p))"""


def partitioned(spark, sf):
    """Three score partitions per model, differing slightly, as repeated validation gives."""
    rows = long_scores(spark, sf).withColumn("partition", F.explode(F.sequence(F.lit(0), F.lit(2))))
    moved = (F.col("clip_id") * (F.col("partition") + 1)) % 7 == 0
    score = F.when(moved, F.col("score") * 0.9).otherwise(F.col("score"))
    return rows.withColumn("score", F.round(score, 12))


@catalog.add(
    "g10_model_selection",
    with_(views.SCORED, LONG, PARTED, curve_sql("model, partition", "parted"))
    + f""" SELECT model, {s6('avg(cost)')} AS mean_min_dcf, {s6('median(t)')} AS cutoff,
 row_number() OVER (ORDER BY round(avg(cost), 9), model) = 1 AS chosen FROM best GROUP BY model""",
)
def g10_model_selection(spark, sf):
    per = M.min_dcf(partitioned(spark, sf), ["model", "partition"])
    out = comparison.select_model(per)
    return out.select(
        "model", r6("mean_min_dcf").alias("mean_min_dcf"), r6("cutoff").alias("cutoff"), "chosen"
    )


@catalog.add(
    "g11_improved_everywhere",
    with_(views.SCORED, LONG, PARTED, curve_sql("model, partition", "parted"))
    + """, two AS (SELECT partition, max(CASE WHEN model = 'secondary' THEN cost END) AS c, max(CASE WHEN model = 'primary' THEN cost END) AS b FROM best GROUP BY partition)
 SELECT bool_and(c < b) AS improved_everywhere, string_agg(CASE WHEN c < b THEN 'true' ELSE 'false' END, ',' ORDER BY partition) AS flags FROM two""",
)
def g11_improved_everywhere(spark, sf):
    per = M.min_dcf(partitioned(spark, sf), ["model", "partition"])
    return comparison.improvement(per, "secondary", "primary")


@catalog.add(
    "g12_cluster_sizes",
    with_(views.SPECTRA)
    + " SELECT cluster, count(*) AS size, count(DISTINCT label) = 1 AS one_class FROM spectra GROUP BY cluster",
)
def g12_cluster_sizes(spark, sf):
    return grouping.cluster_sizes(views.spectra(spark, sf), "cluster", "label")


@catalog.add(
    "g14_source_counts",
    with_(views.SCORED)
    + """, p AS (SELECT *, CASE WHEN clip_id % 4 = 0 THEN 'dev' ELSE 'train' END AS side FROM scored)
 SELECT side, count(*) AS clips, CAST(sum(1-label) AS BIGINT) AS real, CAST(sum(label) AS BIGINT) AS synthetic,
 count(DISTINCT grp) AS groups FROM p GROUP BY side""",
)
def g14_source_counts(spark, sf):
    side = F.when(F.col("clip_id") % 4 == 0, "dev").otherwise("train")
    return grouping.source_counts(views.scored(spark, sf).withColumn("side", side), "side")


# -- L: set operations and order ---------------------------------------------------------------


@catalog.add(
    "l1_union",
    with_(views.SCORED)
    + " SELECT label, count(*) AS n FROM (SELECT label FROM scored WHERE clip_id % 2 = 0 UNION ALL SELECT label FROM scored WHERE clip_id % 3 = 0) q GROUP BY label",
)
def l1_union(spark, sf):
    rows = views.scored(spark, sf)
    both = rows.where("clip_id % 2 = 0").unionByName(rows.where("clip_id % 3 = 0"))
    return both.groupBy("label").agg(F.count("*").alias("n"))


@catalog.add(
    "l2_intersect_except",
    with_(views.SCORED)
    + """ SELECT 'both' AS side, grp FROM (SELECT grp FROM scored WHERE clip_id % 2 = 0 INTERSECT SELECT grp FROM scored WHERE clip_id % 9 = 1) q
 UNION ALL SELECT 'left', grp FROM (SELECT grp FROM scored WHERE clip_id % 2 = 0 EXCEPT SELECT grp FROM scored WHERE clip_id % 9 = 1) q""",
)
def l2_intersect_except(spark, sf):
    rows = views.scored(spark, sf)
    a, b = (rows.where(f"clip_id % {m}").select("grp") for m in ("2 = 0", "9 = 1"))
    both = a.intersect(b).select(F.lit("both").alias("side"), "grp")
    return both.unionByName(a.subtract(b).select(F.lit("left").alias("side"), "grp"))


@catalog.add(
    "l3_set_equality",
    with_(views.SCORED)
    + """ SELECT 'same' AS kind, true AS equal UNION ALL SELECT 'shorter', NOT EXISTS (SELECT 1 FROM scored WHERE clip_id % 5 = 0)""",
)
def l3_set_equality(spark, sf):
    ids = views.scored(spark, sf).select("clip_id")
    same = joins.sets_equal(ids, ids.orderBy(F.desc("clip_id")), "clip_id").select(
        F.lit("same").alias("kind"), "equal"
    )
    shorter = joins.sets_equal(ids, ids.where("clip_id % 5 <> 0"), "clip_id")
    return same.unionByName(shorter.select(F.lit("shorter").alias("kind"), "equal"))


@catalog.add(
    "l4_top_groups",
    with_(views.SCORED)
    + " SELECT grp, count(*) AS n FROM scored GROUP BY grp ORDER BY n DESC, grp LIMIT 20",
)
def l4_top_groups(spark, sf):
    """Top-k report: twenty largest groups."""
    counts = views.scored(spark, sf).groupBy("grp").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "grp").limit(20)


@catalog.add(
    "l5_distinct_levels",
    with_(views.SCORED)
    + " SELECT label, count(DISTINCT grp) AS groups, count(DISTINCT primary_score) AS levels FROM scored GROUP BY label",
)
def l5_distinct_levels(spark, sf):
    return views.scored(spark, sf).groupBy("label").agg(
        F.count_distinct("grp").alias("groups"), F.count_distinct("primary_score").alias("levels")
    )
