"""From out-of-fold choice to unseen data: ranking, a deployable model, transferred cutoffs, recall per attack, blends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipscore.operators import metrics as M
from clipscore.operators import models as Mo
from clipscore.operators.routing import MIN_CLUSTER, routed


def ranking(oof: DataFrame, listed: list[str], deployable: list[str] | None = None) -> DataFrame:
    """(model, min_dcf, threshold, pos, chosen): the lowest out-of-fold cost among ``deployable`` is chosen, on
    ties the first of ``listed``.  Unseen rows have no say."""
    pos = F.array_position(F.array(*map(F.lit, listed)), F.col("model")) - 1
    costs = M.min_dcf(oof, ["model"]).select("model", "min_dcf", "threshold", pos.alias("pos"))
    allowed = F.col("model").isin(listed if deployable is None else deployable)
    best = costs.agg(F.min_by("model", F.when(allowed, F.struct(F.round("min_dcf", 9), "pos")))).scalar()
    return costs.withColumn("chosen", F.col("model") == best)


def transferred(oof: DataFrame, unseen: DataFrame, listed: list[str], deployable: list[str] | None = None) -> DataFrame:
    """Per model: out-of-fold cost and cutoff, whether it is chosen, and cost and error rates of that cutoff on
    unseen rows.  The few cutoffs meet the rows in a join that Spark broadcasts on their size."""
    cuts = ranking(oof, listed, deployable)
    keys = ["model", "min_dcf", "threshold", "chosen"]
    rated = M.dcf_at(unseen.join(cuts, "model"), keys, F.col("threshold"))
    return rated.select(
        "model", F.col("min_dcf").alias("oof_min_dcf"), F.col("threshold").alias("cutoff"), "chosen",
        F.col("dcf").alias("unseen_dcf"), F.col("fa").alias("far"), "miss",
    )


def attack_recall(oof: DataFrame, unseen: DataFrame) -> DataFrame:
    """(grp, model, spoofs, recall): share of each attack's unseen clips found at the model's out-of-fold cutoff."""
    cuts = M.min_dcf(oof, ["model"]).select("model", "threshold")
    found = (F.col("score") >= F.col("threshold")).cast("double")
    attacks = unseen.where("label = 1").join(cuts, "model")
    return attacks.groupBy("grp", "model").agg(F.count("*").alias("spoofs"), F.avg(found).alias("recall"))


def best_pair(oof: DataFrame, listed: list[str]) -> tuple[str, str]:
    """The two models of lowest out-of-fold cost (two names to the driver)."""
    order = ranking(oof, listed).orderBy(F.round("min_dcf", 9), "pos").limit(2).collect()
    return order[0]["model"], order[1]["model"]


def pair_policies(
    oof: DataFrame, unseen: DataFrame, quality: DataFrame, pair: tuple[str, str], clusters: int = 3, min_size: int = MIN_CLUSTER, restarts: int = 20
) -> DataFrame:
    """Metrics on unseen rows of the overall and the conditional blend of a pair, both fitted on out-of-fold scores."""

    def wide(rows: DataFrame) -> DataFrame:
        of = [F.max(F.when(F.col("model") == m, F.col("score"))).alias(n) for m, n in zip(pair, "ab")]
        both = rows.where(F.col("model").isin(*pair)).groupBy("clip_id", "label").agg(*of)
        return both.join(quality.select("clip_id", "quality"), "clip_id")

    router = Mo.fit_condition_router(wide(oof), "quality", "a", "b", clusters, min_size, restarts)
    out = routed(wide(unseen), router, "quality", "a", "b")
    overall = F.lit(router.overall) * F.col("a") + F.lit(1 - router.overall) * F.col("b")
    policies = F.create_map(F.lit("overall"), overall, F.lit("conditional"), F.col("routed"))
    long_ = out.select("label", F.explode(policies).alias("policy", "score"))
    return M.summary(long_.withColumn("score", F.round("score", 12)), ["policy"])
