"""Detection-metric queries (I1-I11) over the scored manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipscore import views
from clipscore.catalog.common import Catalog, r6, s6, with_
from clipscore.operators import metrics as M

catalog = Catalog()

DOMAIN = "CASE WHEN (clip_id * 13) % 3 = 0 THEN 'a' WHEN (clip_id * 13) % 3 = 1 THEN 'b' ELSE 'c' END"


def long_scores(spark, sf):
    """Manifest with one row per (clip, model)."""
    return views.scored(spark, sf).select(
        "clip_id",
        "label",
        "grp",
        "status",
        F.expr(DOMAIN).alias("corpus"),
        F.expr("stack(2, 'primary', primary_score, 'secondary', secondary_score) AS (model, score)"),
    )


LONG = f"""long AS (
SELECT clip_id, label, grp, status, {DOMAIN} AS corpus, 'primary' AS model, primary_score AS score FROM scored
UNION ALL
SELECT clip_id, label, grp, status, {DOMAIN} AS corpus, 'secondary' AS model, secondary_score AS score FROM scored)"""


def curve_sql(keys: str, source: str = "long", score: str = "score") -> str:
    """Plain-window SQL for the score curve and the minDCF candidates, keyed by ``keys``."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""pts AS (SELECT {k}{score} AS t, sum(1-label) AS r, sum(label) AS p FROM {source} GROUP BY {k}{score}),
cum AS (SELECT *, sum(r) OVER ({part}ORDER BY t) - r AS rb, sum(p) OVER ({part}ORDER BY t) - p AS pb,
       sum(r) OVER ({part}) AS nr, sum(p) OVER ({part}) AS np,
       lag(r) OVER ({part}ORDER BY t) AS r0, lag(p) OVER ({part}ORDER BY t) AS p0 FROM pts),
cand AS (SELECT {k}t, 0 AS accept_all, rb, pb, nr, np FROM cum
         UNION ALL SELECT {k}max(t), 1, max(nr), max(np), max(nr), max(np) FROM cum {group}),
costed AS (SELECT {k}t, accept_all, pb*1e0/np AS miss, (nr-rb)*1e0/nr AS fa,
           (3e-1*(pb*1e0/np) + 28e-1*((nr-rb)*1e0/nr))/3e-1 AS cost FROM cand),
best AS (SELECT * FROM (SELECT *, row_number() OVER ({part}ORDER BY cost, accept_all, t) AS pick FROM costed) q
         WHERE pick = 1),
roc AS (SELECT {k}t, (nr-rb)*1e0/nr AS fpr, 1e0 - pb*1e0/np AS tpr FROM cum
        WHERE (rb + r = nr AND pb + p = np) OR r0 IS NULL OR r0 <> r OR p0 <> p
        UNION ALL SELECT {k}CAST('Infinity' AS DOUBLE), 0e0, 0e0 FROM cum {group}),
eer AS (SELECT * FROM (SELECT *, row_number() OVER ({part}ORDER BY abs(fpr-(1e0-tpr)), t DESC) AS pick FROM roc) q
        WHERE pick = 1)"""


@catalog.add(
    "i1_min_dcf",
    with_(views.SCORED, LONG, curve_sql("model"))
    + f" SELECT model, {s6('cost')} AS min_dcf, {s6('t')} AS threshold, accept_all = 1 AS accept_all FROM best",
)
def i1_min_dcf(spark, sf):
    out = M.min_dcf(long_scores(spark, sf), ["model"])
    return out.select(
        "model", r6("min_dcf").alias("min_dcf"), r6("threshold").alias("threshold"), "accept_all"
    )


@catalog.add(
    "i1_min_dcf_costs",
    with_(
        views.SCORED,
        LONG,
        curve_sql("model").replace(
            "(3e-1*(pb*1e0/np) + 28e-1*((nr-rb)*1e0/nr))/3e-1",
            "(95e-2*(pb*1e0/np) + 5e-1*((nr-rb)*1e0/nr))/5e-1",
        ),
    )
    + f" SELECT model, {s6('cost')} AS min_dcf, {s6('t')} AS threshold, accept_all = 1 AS accept_all FROM best",
)
def i1_min_dcf_costs(spark, sf):
    """The older published cost, (0.95 miss + 0.5 false alarm) / 0.5."""
    costs = M.Costs(p_spoof=0.5, c_miss=1.9, c_fa=1.0)
    out = M.min_dcf(long_scores(spark, sf), ["model"], costs=costs)
    return out.select(
        "model", r6("min_dcf").alias("min_dcf"), r6("threshold").alias("threshold"), "accept_all"
    )


@catalog.add(
    "i2_dcf_at_cutoff",
    with_(views.SCORED, LONG)
    + f""", rated AS (SELECT model, c, avg(CASE WHEN label = 1 THEN CASE WHEN score < c THEN 1e0 ELSE 0e0 END END) AS miss,
 avg(CASE WHEN label = 0 THEN CASE WHEN score >= c THEN 1e0 ELSE 0e0 END END) AS fa
 FROM long, (VALUES (25e-2), (5e-1), (75e-2)) AS cuts(c) GROUP BY model, c)
 SELECT model, c AS cutoff, {s6('(3e-1*miss + 28e-1*fa)/3e-1')} AS dcf, {s6('miss')} AS miss, {s6('fa')} AS fa FROM rated""",
)
def i2_dcf_at_cutoff(spark, sf):
    rows = long_scores(spark, sf).withColumn(
        "cutoff", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    )
    out = M.dcf_at(rows, ["model", "cutoff"], F.col("cutoff"))
    return out.select("model", "cutoff", *[r6(c).alias(c) for c in ("dcf", "miss", "fa")])


@catalog.add(
    "i3_roc_points",
    with_(views.SCORED, LONG, curve_sql("model"))
    + f" SELECT model, {s6('t')} AS threshold, {s6('fpr')} AS fpr, {s6('tpr')} AS tpr FROM roc",
)
def i3_roc_points(spark, sf):
    out = M.roc_points(M.score_curve(long_scores(spark, sf), ["model"]), ["model"])
    return out.select("model", *[r6(c).alias(c) for c in ("threshold", "fpr", "tpr")])


AUC_SQL = """ranks AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score)
 + (count(*) OVER (PARTITION BY model, score) - 1) / 2e0 AS rk FROM long),
auc AS (SELECT model, (sum(CASE WHEN label = 1 THEN rk ELSE 0e0 END) - sum(label)*(sum(label)+1)/2e0)
 / (sum(label)*1e0*sum(1-label)) AS auc FROM ranks GROUP BY model)"""


@catalog.add(
    "i4_roc_auc",
    with_(views.SCORED, LONG, AUC_SQL) + f" SELECT model, {s6('auc')} AS auc FROM auc",
)
def i4_roc_auc(spark, sf):
    out = M.auc(M.score_curve(long_scores(spark, sf), ["model"]), ["model"])
    return out.select("model", r6("auc").alias("auc"))


AP_SQL = "ap AS (SELECT {k}sum(p*1e0/np * ((np-pb)*1e0/(np-pb+nr-rb))) AS ap FROM cum {g})"


@catalog.add(
    "i5_average_precision",
    with_(views.SCORED, LONG, curve_sql("model"), AP_SQL.format(k="model, ", g="GROUP BY model"))
    + f" SELECT model, {s6('ap')} AS ap FROM ap",
)
def i5_average_precision(spark, sf):
    out = M.average_precision(M.score_curve(long_scores(spark, sf), ["model"]), ["model"])
    return out.select("model", r6("ap").alias("ap"))


@catalog.add(
    "i6_eer",
    with_(views.SCORED, LONG, curve_sql("model"))
    + f" SELECT model, {s6('(fpr + (1e0-tpr))/2e0')} AS eer FROM eer",
)
def i6_eer(spark, sf):
    out = M.eer(M.score_curve(long_scores(spark, sf), ["model"]), ["model"])
    return out.select("model", r6("eer").alias("eer"))


@catalog.add(
    "i7_rates_at_min_dcf",
    with_(views.SCORED, LONG, curve_sql("model"))
    + f""" SELECT l.model, {s6('avg(CASE WHEN label = 0 THEN CASE WHEN accept_all = 0 AND score >= t THEN 1e0 ELSE 0e0 END END)')} AS far,
 {s6('avg(CASE WHEN label = 1 THEN CASE WHEN accept_all = 0 AND score >= t THEN 0e0 ELSE 1e0 END END)')} AS miss
 FROM long l JOIN best b ON l.model = b.model GROUP BY l.model""",
)
def i7_rates_at_min_dcf(spark, sf):
    out = M.summary(long_scores(spark, sf), ["model"])
    return out.select("model", r6("far").alias("far"), r6("miss").alias("miss"))


@catalog.add(
    "i8_threshold_transfer",
    with_(
        views.SCORED,
        LONG,
        "train AS (SELECT * FROM long WHERE corpus <> 'a')",
        "dev AS (SELECT * FROM long WHERE corpus = 'a')",
        curve_sql("model", "train"),
    )
    + f""" SELECT d.model, {s6('max(t)')} AS cutoff,
 {s6('avg(CASE WHEN label = 0 THEN CASE WHEN score >= t THEN 1e0 ELSE 0e0 END END)')} AS far,
 {s6('avg(CASE WHEN label = 1 THEN CASE WHEN score < t THEN 1e0 ELSE 0e0 END END)')} AS miss
 FROM dev d JOIN best b ON d.model = b.model GROUP BY d.model""",
)
def i8_threshold_transfer(spark, sf):
    """Cutoff chosen on one side only, error rates on the other (here: corpus a)."""
    rows = long_scores(spark, sf)
    cuts = M.min_dcf(rows.where("corpus <> 'a'"), ["model"]).select("model", "threshold")
    dev = rows.where("corpus = 'a'").join(cuts, "model")
    out = M.dcf_at(dev, ["model", "threshold"], F.col("threshold"))
    return out.select(
        "model", r6("threshold").alias("cutoff"), r6("fa").alias("far"), r6("miss").alias("miss")
    )


@catalog.add(
    "i9_paired_stability",
    with_(views.SCORED)
    + f""", ranks AS (SELECT label, primary_score AS a, secondary_score AS b,
 rank() OVER (PARTITION BY label ORDER BY primary_score) + (count(*) OVER (PARTITION BY label, primary_score) - 1)/2e0 AS ra,
 rank() OVER (PARTITION BY label ORDER BY secondary_score) + (count(*) OVER (PARTITION BY label, secondary_score) - 1)/2e0 AS rb
 FROM scored) SELECT label, count(*) AS n, {s6('avg(abs(a-b))')} AS mean_change, {s6('max(abs(a-b))')} AS max_change,
 {s6('corr(ra, rb)')} AS rank_correlation FROM ranks GROUP BY label""",
)
def i9_paired_stability(spark, sf):
    out = M.stability(views.scored(spark, sf), ["label"], "primary_score", "secondary_score")
    return out.select(
        "label", "n", *[r6(c).alias(c) for c in ("mean_change", "max_change", "rank_correlation")]
    )


@catalog.add(
    "i10_partition_agreement",
    with_(
        views.SPECTRA,
        "cells AS (SELECT label AS a, cluster % 5 AS b, count(*) AS n FROM spectra GROUP BY 1, 2)",
        "ra AS (SELECT a, sum(n) AS n FROM cells GROUP BY a)",
        "rb AS (SELECT b, sum(n) AS n FROM cells GROUP BY b)",
        """t AS (SELECT (SELECT sum(n)*1e0 FROM cells) AS big, (SELECT sum(n*(n-1)/2e0) FROM cells) AS j,
 (SELECT sum(n*(n-1)/2e0) FROM ra) AS pa, (SELECT sum(n*(n-1)/2e0) FROM rb) AS pb)""",
        """h AS (SELECT (SELECT -sum(n/big*ln(n/big)) FROM ra) AS ha, (SELECT -sum(n/big*ln(n/big)) FROM rb) AS hb,
 (SELECT sum(c.n/big*ln((c.n*big)/(x.n*1e0*y.n))) FROM cells c JOIN ra x ON c.a = x.a JOIN rb y ON c.b = y.b) AS mi FROM t)""",
    )
    + f""" SELECT {s6('(j - pa*pb/(big*(big-1)/2e0)) / ((pa+pb)/2e0 - pa*pb/(big*(big-1)/2e0))')} AS adjusted_rand,
 {s6('mi/((ha+hb)/2e0)')} AS nmi FROM t, h""",
)
def i10_partition_agreement(spark, sf):
    rows = views.spectra(spark, sf).select("label", (F.col("cluster") % 5).alias("other"))
    out = M.agreement(rows, "label", "other")
    return out.select(r6("adjusted_rand").alias("adjusted_rand"), r6("nmi").alias("nmi"))


@catalog.add(
    "i11_metric_bundle",
    with_(
        views.SCORED,
        LONG,
        curve_sql("model, corpus"),
        "ap AS (SELECT model, corpus, sum(p*1e0/np * ((np-pb)*1e0/(np-pb+nr-rb))) AS ap,"
        " sum(p*(rb + r/2e0)) / (max(nr)*1e0*max(np)) AS auc FROM cum GROUP BY model, corpus)",
    )
    + f""" SELECT b.model, b.corpus, {s6('cost')} AS min_dcf, {s6('b.t')} AS threshold, {s6('fa')} AS far, {s6('miss')} AS miss,
 {s6('(fpr + (1e0-tpr))/2e0')} AS eer, {s6('auc')} AS auc, {s6('ap')} AS ap
 FROM best b JOIN eer e ON b.model = e.model AND b.corpus = e.corpus JOIN ap a ON b.model = a.model AND b.corpus = a.corpus""",
)
def i11_metric_bundle(spark, sf):
    out = M.summary(long_scores(spark, sf), ["model", "corpus"])
    return out.select(
        "model",
        "corpus",
        *[r6(c).alias(c) for c in ("min_dcf", "threshold", "far", "miss", "eer", "auc", "ap")],
    )
