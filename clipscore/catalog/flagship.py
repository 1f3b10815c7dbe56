"""The end-to-end query: score checks, container prior, blend, then every metric per corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipscore import views
from clipscore.catalog.common import Catalog, r6, s6, with_
from clipscore.catalog.metrics import DOMAIN, curve_sql
from clipscore.functions.scores import container_adjusted, in_unit, mix
from clipscore.operators import metrics as M

catalog = Catalog()

FUSED = f"""fused AS (SELECT {DOMAIN} AS corpus, label, round(greatest(0e0, least(1e0,
 5e-1*(CASE WHEN status = 'consistent' THEN primary_score*(1e0-5e-2) ELSE primary_score END) + (1e0-5e-1)*secondary_score)), 12) AS score
 FROM scored WHERE primary_score BETWEEN 0 AND 1 AND secondary_score BETWEEN 0 AND 1)"""


@catalog.add(
    "flagship_blend_min_dcf",
    with_(views.SCORED, FUSED, curve_sql("corpus", "fused"))
    + f""" SELECT b.corpus, {s6('cost')} AS min_dcf, {s6('b.t')} AS threshold, {s6('fa')} AS far, {s6('miss')} AS miss,
 {s6('(fpr + (1e0-tpr))/2e0')} AS eer FROM best b JOIN eer e ON b.corpus = e.corpus""",
)
def flagship(spark, sf):
    a, b = F.col("primary_score"), F.col("secondary_score")
    rows = views.scored(spark, sf).where(in_unit(a) & in_unit(b))
    score = mix(0.5, container_adjusted(a, F.col("status")), b)
    fused = rows.select(F.expr(DOMAIN).alias("corpus"), "label", F.round(score, 12).alias("score"))
    out = M.summary(fused, ["corpus"])
    return out.select(
        "corpus", *[r6(c).alias(c) for c in ("min_dcf", "threshold", "far", "miss", "eer")]
    )
