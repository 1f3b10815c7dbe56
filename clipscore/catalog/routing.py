"""Blending and routing queries (F8-F10, K1, K15-K22) with supplied scores or clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipscore import views
from clipscore.catalog.common import Catalog, r6, s6, with_
from clipscore.catalog.metrics import curve_sql
from clipscore.operators import routing as R

catalog = Catalog()

GRID = """grid AS (SELECT label, i/2e1 AS alpha, round(i/2e1*primary_score + (1e0 - i/2e1)*secondary_score, 12) AS score
 FROM scored, range(0, 21) q(i))"""


@catalog.add(
    "f8_alpha_grid",
    with_(views.SCORED, GRID, curve_sql("alpha", "grid"))
    + f" SELECT {s6('alpha')} AS alpha, {s6('cost')} AS min_dcf FROM best",
)
def f8_alpha_grid(spark, sf):
    out = R.alpha_costs(views.scored(spark, sf), [], "primary_score", "secondary_score")
    return out.select(r6("alpha").alias("alpha"), r6("min_dcf").alias("min_dcf"))


WEIGHTS = """wgrid AS (SELECT label, m, t, round(t*secondary_score + (1e0-t)*CASE WHEN status = 'consistent' THEN primary_score*(1e0-m) ELSE primary_score END, 12) AS score
 FROM scored, (VALUES (0e0), (25e-3), (5e-2), (75e-3), (1e-1)) a(m), (VALUES (0e0), (25e-2), (5e-1), (75e-2), (1e0)) b(t))"""


@catalog.add(
    "f8_weight_grid",
    # The curve's own threshold column is called t, so the temporal weight is renamed here.
    with_(
        views.SCORED,
        WEIGHTS.replace("SELECT label, m, t,", "SELECT label, m, t AS tw,"),
        curve_sql("m, tw", "wgrid"),
    )
    + f" SELECT m AS metadata_weight, tw AS temporal_weight, {s6('cost')} AS min_dcf FROM best",
)
def f8_weight_grid(spark, sf):
    out = R.weight_costs(views.scored(spark, sf), [], "primary_score", "secondary_score")
    return out.select(
        F.col("m").alias("metadata_weight"),
        F.col("t").alias("temporal_weight"),
        r6("min_dcf").alias("min_dcf"),
    )


@catalog.add(
    "k16_select_alpha",
    with_(views.SCORED, GRID, curve_sql("alpha", "grid"))
    + f" SELECT {s6('alpha')} AS alpha, {s6('cost')} AS cost FROM best ORDER BY best.cost, best.alpha LIMIT 1",
)
def k16_select_alpha(spark, sf):
    out = R.select_alpha(views.scored(spark, sf), [], "primary_score", "secondary_score")
    return out.select(r6("alpha").alias("alpha"), r6("cost").alias("cost"))


@catalog.add(
    "k17_select_weights",
    with_(
        views.SCORED,
        WEIGHTS.replace("SELECT label, m, t,", "SELECT label, m, t AS tw,"),
        curve_sql("m, tw", "wgrid"),
    )
    + f""" SELECT tw AS temporal_weight, m AS metadata_weight, {s6('cost')} AS cost FROM best
 ORDER BY best.cost, abs(tw - 5e-1), abs(m - 5e-2), m, tw LIMIT 1""",
)
def k17_select_weights(spark, sf):
    out = R.select_weights(views.scored(spark, sf), [], "primary_score", "secondary_score")
    return out.withColumn("cost", r6("cost"))


@catalog.add(
    "k15_blend_explanation",
    with_(views.SCORED)
    + f""", e AS (SELECT clip_id, status, 75e-2*primary_score + 25e-2*secondary_score AS audio FROM scored)
 SELECT clip_id, {s6('audio')} AS audio_score, {s6("CASE WHEN status = 'consistent' THEN audio*(1e0-5e-2) ELSE audio END")} AS score,
 {s6("CASE WHEN status = 'consistent' THEN audio*(1e0-5e-2) - audio ELSE 0e0 END")} AS metadata_adjustment, 2 AS components FROM e""",
)
def k15_blend_explanation(spark, sf):
    out = R.explain_blend(
        views.scored(spark, sf), {"primary_score": 0.75, "secondary_score": 0.25}
    )
    return out.select(
        "clip_id",
        *[r6(c).alias(c) for c in ("audio_score", "score", "metadata_adjustment")],
        F.size("component_scores").alias("components"),
    )


# -- supplied partition over the spectra -------------------------------------------------------


def routed_rows(spark, sf):
    """Spectra with their ten-class label as the cluster and two scores read off the spectrum."""
    one = F.lit(1.0)
    a = F.least(one, F.get("mag", 0) * 2 + 0.2 * F.col("label"))
    b = F.least(one, F.get("mag", 1) * 2 + 0.1 * F.col("label"))
    return views.spectra(spark, sf).select(
        "clip_id",
        ((F.col("clip_id") * 7) % 3 == 0).cast("int").alias("label"),
        "cluster",
        "mag",
        F.round(a, 12).alias("a"),
        F.round(b, 12).alias("b"),
    )


ROWS = """rows AS (SELECT clip_id, CASE WHEN (clip_id*7) % 3 = 0 THEN 1 ELSE 0 END AS label, cluster, mag,
 round(least(1e0, mag[1]*2 + 2e-1*label), 12) AS a, round(least(1e0, mag[2]*2 + 1e-1*label), 12) AS b FROM spectra)"""

STATS = """el AS (SELECT clip_id, cluster, generate_subscripts(mag, 1) AS pos, unnest(mag) AS v FROM rows),
st AS (SELECT pos, avg(v) AS mean, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1e0 END AS sd FROM el GROUP BY pos),
z AS (SELECT clip_id, cluster, el.pos, (v - mean)/sd AS z FROM el JOIN st ON el.pos = st.pos),
cen AS (SELECT cluster, pos, avg(z) AS c FROM z GROUP BY cluster, pos),
dist AS (SELECT z.clip_id, cen.cluster, round(sum((z.z-cen.c)*(z.z-cen.c)), 9) AS d FROM z JOIN cen ON z.pos = cen.pos GROUP BY z.clip_id, cen.cluster),
near AS (SELECT clip_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY d, cluster) AS r FROM dist) q WHERE r = 1)"""

# Overall (scope -1) and per-cluster grids.
CLUSTER_ALPHA = (
    """cgrid AS (SELECT scope, label, i/2e1 AS alpha, round(i/2e1*a + (1e0 - i/2e1)*b, 12) AS score
 FROM (SELECT cluster AS scope, label, a, b FROM rows UNION ALL SELECT -1, label, a, b FROM rows) q, range(0, 21) g(i)),
"""
    + curve_sql("scope, alpha", "cgrid").replace("nr-rb)*1e0/nr", "nr-rb)*1e0/nullif(nr, 0)").replace("pb*1e0/np", "pb*1e0/nullif(np, 0)")
    + """,
chosen AS (SELECT scope, alpha FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY cost, alpha) AS r FROM best WHERE cost IS NOT NULL) q WHERE r = 1),
weights AS (SELECT f.cluster, size, size >= 40 AND both_classes AS own,
 CASE WHEN size >= 40 AND both_classes THEN c.alpha ELSE o.alpha END AS alpha, o.alpha AS overall
 FROM (SELECT cluster, count(*) AS size, min(label) <> max(label) AS both_classes FROM rows GROUP BY cluster) f
 LEFT JOIN chosen c ON f.cluster = c.scope, (SELECT alpha FROM chosen WHERE scope = -1) o)"""
)


@catalog.add(
    "k1_standardize",
    with_(views.SPECTRA, ROWS, STATS)
    + f" SELECT clip_id, CAST(pos - 1 AS INT) AS pos, {s6('z')} AS z FROM z",
)
def k1_standardize(spark, sf):
    rows = routed_rows(spark, sf)
    out = R.standardized(rows, R.scaler(rows, "mag"), "mag", "z")
    return out.select("clip_id", F.posexplode("z").alias("pos", "z")).withColumn("z", r6("z"))


@catalog.add(
    "f9_nearest_centroid",
    with_(views.SPECTRA, ROWS, STATS) + " SELECT clip_id, cluster FROM near",
)
def f9_nearest_centroid(spark, sf):
    rows = routed_rows(spark, sf)
    scaled = R.standardized(rows, R.scaler(rows, "mag"), "mag", "z")
    centers = R.centroids(scaled, "cluster", "z")
    return R.nearest(scaled.select("clip_id", "z"), centers, "z").select("clip_id", "cluster")


@catalog.add(
    "f10_cluster_alpha",
    with_(views.SPECTRA, ROWS)
    + " SELECT clip_id, CASE WHEN cluster IN (1, 3, 5) THEN cluster/1e1 ELSE 5e-1 END AS alpha FROM rows",
)
def f10_cluster_alpha(spark, sf):
    """Lookup with a default: only some clusters carry a weight of their own."""
    known = views.spectra(spark, sf).where("cluster IN (1, 3, 5)").select("cluster").distinct()
    table = known.withColumn("alpha", F.col("cluster") / 10.0)
    rows = routed_rows(spark, sf).select("clip_id", "cluster")
    return rows.join(table, "cluster", "left").select(
        "clip_id", F.coalesce("alpha", F.lit(0.5)).alias("alpha")
    )


@catalog.add(
    "k20_cluster_alphas",
    with_(views.SPECTRA, ROWS, CLUSTER_ALPHA)
    + f" SELECT cluster, size, own, {s6('alpha')} AS alpha FROM weights",
)
def k20_cluster_alphas(spark, sf):
    out = R.cluster_alphas(routed_rows(spark, sf), "cluster", "a", "b")
    return out.select("cluster", "size", "own", r6("alpha").alias("alpha"))


@catalog.add(
    "k21_supplied_partition",
    with_(
        views.SPECTRA,
        ROWS,
        CLUSTER_ALPHA,
        """pol AS (SELECT 'overall' AS policy, label, round(overall*a + (1e0-overall)*b, 12) AS score FROM rows r JOIN weights w ON r.cluster = w.cluster
 UNION ALL SELECT 'conditional', label, round(alpha*a + (1e0-alpha)*b, 12) FROM rows r JOIN weights w ON r.cluster = w.cluster)""",
        curve_sql("policy", "pol")
        .replace("pts", "pts2").replace("cum", "cum2").replace("cand", "cand2")
        .replace("costed", "costed2").replace("best", "best2").replace("roc ", "roc2 ").replace("eer", "eer2"),
    )
    + f" SELECT policy, {s6('cost')} AS min_dcf FROM best2",
)
def k21_supplied_partition(spark, sf):
    out = R.router_summary(routed_rows(spark, sf), "cluster", "a", "b")
    return out.select("policy", r6("min_dcf").alias("min_dcf"))


@catalog.add(
    "k22_routed_score",
    with_(views.SPECTRA, ROWS, STATS, CLUSTER_ALPHA)
    + f""" SELECT r.clip_id, n.cluster, {s6('greatest(0e0, least(1e0, w.alpha*a + (1e0-w.alpha)*b))')} AS routed
 FROM rows r JOIN near n ON r.clip_id = n.clip_id JOIN weights w ON n.cluster = w.cluster""",
)
def k22_routed_score(spark, sf):
    rows = routed_rows(spark, sf)
    router = R.fit_router(rows, "cluster", "mag", "a", "b")
    out = R.routed(rows.drop("cluster"), router, "mag", "a", "b")
    return out.select("clip_id", "cluster", r6("routed").alias("routed"))
