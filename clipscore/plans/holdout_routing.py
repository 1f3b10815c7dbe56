"""Condition routing measured on random group holdouts, and the final router on all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipscore.operators import metrics as M
from clipscore.operators import routing as R
from clipscore.operators import splits
from clipscore.operators.clusters import keyed_kmeans
from clipscore.operators.comparison import blended

FINAL = -1  # the "holdout" that trains on every row
SHARE, SEED = 0.25, 73  # fixed values: held share of the groups, first seed
WEIGHTS = "fold int, cluster int, size bigint, own boolean, alpha double, overall double"


def roles(df: DataFrame, holdouts: int = 5, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """``df`` with ``train`` and ``test``: arrays of the holdouts (0 on) in which a row trains or is held out.

    Holdouts whose train or test side lacks a class appear in neither.  Everything trains for ``FINAL``.
    """
    drawn = splits.group_holdouts(df, "label", "grp", share, list(range(seed, seed + holdouts)))
    number = (F.col("seed") - seed).cast("int")
    sides = drawn.groupBy("grp").agg(
        F.sort_array(F.collect_list(F.when(~F.col("held"), number))).alias("train"),
        F.sort_array(F.collect_list(F.when(F.col("held"), number))).alias("test"),
    )
    none = F.array().cast("array<int>")
    out = df.join(sides, "grp", "left")
    every = F.concat(F.coalesce("train", none), F.array(F.lit(FINAL)))
    return out.withColumn("train", every).withColumn("test", F.coalesce("test", none))


def by_holdout(rows: DataFrame) -> DataFrame:
    """A row for every holdout that a row of :func:`roles` plays a part in: ``fold`` and ``held``."""
    part = lambda c, held: F.transform(c, lambda f: F.struct(f.alias("fold"), F.lit(held).alias("held")))
    return rows.select("*", F.inline(F.concat(part("train", False), part("test", True)))).drop("train", "test")


def placed(rows: DataFrame, fits: DataFrame, quality: str) -> DataFrame:
    """Add ``cluster``, the nearest centre (lowest index on ties) in the fit of the row's holdout.

    ``fits`` has one row a holdout and is broadcast: dealt by holdout, the rows would lie in as many tasks as there are
    holdouts, whatever their number.
    """
    def gap(center: Column) -> Column:
        return F.aggregate(F.zip_with("_z", center, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, v: total + v)

    z = F.zip_with(F.zip_with(quality, "mean", lambda x, m: x - m), "scale", lambda x, s: x / s)
    near = F.array_min(F.transform("centers", lambda c, i: F.struct(gap(c).alias("d"), i.alias("i"))))
    table = F.broadcast(fits.select(F.col("key").alias("fold"), "mean", "scale", "centers"))
    met = rows.join(table, "fold").withColumn("_z", z)
    return met.withColumn("cluster", near["i"]).drop("mean", "scale", "centers", "_z")


def weights(train: DataFrame, a: str, b: str, min_size: int = R.MIN_CLUSTER) -> DataFrame:
    """(fold, cluster, size, own, alpha, overall): the grids of all clusters of all holdouts are one job.

    A cluster has a weight of its own where it is large enough and holds both classes, else the overall one.
    """
    scoped = train.select("fold", "label", a, b, F.explode(F.array(F.col("cluster").cast("int"), F.lit(-1))).alias("scope"))
    best = R.select_alpha(scoped, ["fold", "scope"], a, b).select("fold", "scope", "alpha")
    overall = best.where("scope = -1").select("fold", F.col("alpha").alias("overall"))
    facts = train.groupBy("fold", F.col("cluster").cast("int").alias("scope")).agg(
        F.count("*").alias("size"), (F.min("label") != F.max("label")).alias("both")
    )
    own = (F.col("size") >= min_size) & F.col("both")
    return (
        facts.join(best, ["fold", "scope"], "left")
        .join(overall, "fold")
        .select("fold", F.col("scope").alias("cluster"), "size", own.alias("own"), F.when(own, F.col("alpha")).otherwise(F.col("overall")).alias("alpha"), "overall")
    )


def policies(test: DataFrame, table: DataFrame, a: str, b: str) -> DataFrame:
    """(fold, clip_id, label, policy, score) of held-out rows under the overall and the cluster-wise blend."""
    overall = table.groupBy("fold").agg(F.max("overall").alias("overall"))
    rows = test.join(overall, "fold").join(table.select("fold", "cluster", "alpha"), ["fold", "cluster"], "left")
    alpha = F.coalesce("alpha", "overall")
    each = [
        F.struct(F.lit("overall").alias("policy"), blended(F.col("overall"), F.col(a), F.col(b)).alias("score")),
        F.struct(F.lit("conditional").alias("policy"), blended(alpha, F.col(a), F.col(b)).alias("score")),
    ]
    return rows.select("fold", "clip_id", "label", F.inline(F.array(*each)))


def report(scores: DataFrame, table: DataFrame) -> DataFrame:
    """(fold, alpha, overall_dcf, conditional_dcf) of every holdout and, with null fold and alpha, their means."""
    costs = M.min_dcf(scores, ["fold", "policy"])
    of = lambda p: F.max(F.when(F.col("policy") == p, F.col("min_dcf"))).alias(f"{p}_dcf")
    per = costs.groupBy("fold").agg(of("overall"), of("conditional"))
    alphas = table.groupBy("fold").agg(F.max("overall").alias("alpha"))
    each = per.join(alphas, "fold").select("fold", "alpha", "overall_dcf", "conditional_dcf")
    means = each.agg(*[F.avg(c).alias(c) for c in ("overall_dcf", "conditional_dcf")])
    return each.unionByName(means, allowMissingColumns=True)


def evaluate(
    df: DataFrame,
    quality: str,
    a: str,
    b: str,
    holdouts: int = 5,
    clusters: int = 3,
    min_size: int = R.MIN_CLUSTER,
    restarts: int = 20,
    seed: int = SEED,
) -> tuple[DataFrame, R.Router]:
    """Report of the holdouts, and the router fitted on all rows.

    ``df`` is (clip_id, label, grp, ``quality``, ``a``, ``b``) with out-of-fold component scores.  Scaler,
    clusters and weights of a holdout see its training groups alone; one call of the clustering serves all
    holdouts and the final router.  Neither result refits anything when it is read.
    """
    spark = df.sparkSession
    rows = roles(df.select("clip_id", "label", "grp", quality, a, b), holdouts, seed=seed)
    fits = keyed_kmeans(rows, quality, "train", "clip_id", clusters, restarts, min_size=min_size)
    parts = placed(by_holdout(rows), fits, quality).persist()
    try:
        table = spark.createDataFrame(weights(parts.where("NOT held"), a, b, min_size).collect(), WEIGHTS)
        made = report(policies(parts.where("held"), table, a, b), table).collect()  # a row a holdout
    finally:
        parts.unpersist()
    own = table.where(F.col("fold") == FINAL)
    first = own.first()
    if first is None:
        raise ValueError("no rows of both classes to fit a router on")
    final = fits.where(F.col("key") == FINAL)
    centers = final.select(F.posexplode("centers").alias("cluster", "center"))
    router = R.Router(final.select("mean", "scale"), centers, own.select("cluster", "alpha", "own", "size"), first["overall"])
    return spark.createDataFrame(made, "fold int, alpha double, overall_dcf double, conditional_dcf double"), router


def cross_fitted_routing(oof: DataFrame, quality: DataFrame, folds: int, models: list[str], restarts: int = 20) -> DataFrame:
    """Per fold: rank models (ties in the order of ``models``) and fit the router on the other folds only, then
    score the fold.

    Returns (clip_id, label, fold, policy, score) for the overall and the conditional blend.  The folds share all
    jobs: one of the ranks, the passes of one clustering, one of the weights.
    """
    spark = oof.sparkSession
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    rest = oof.withColumn("_without", F.explode(others))
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    costs = M.min_dcf(rest, ["_without", "model"]).select("_without", F.struct(F.round("min_dcf", 12).alias("cost"), place.alias("place"), "model").alias("m"))
    ranks = costs.groupBy("_without").agg(F.slice(F.sort_array(F.collect_list("m")), 1, 2)["model"].alias("best")).collect()  # a row a fold
    chosen = spark.createDataFrame([(r["_without"], *r["best"]) for r in ranks], "fold int, first string, second string")
    wide = oof.groupBy("clip_id", "label", F.col("fold").cast("int").alias("fold")).agg(
        F.map_from_entries(F.collect_list(F.struct("model", "score"))).alias("_scores")
    )
    rows = wide.join(quality, "clip_id").select(
        "clip_id", "label", "quality", "_scores", others.alias("train"), F.array("fold").alias("test")
    ).persist()
    try:
        fits = keyed_kmeans(rows, "quality", "train", "clip_id", restarts=restarts)
        of = lambda c: F.col("_scores")[F.col(c)]
        paired = by_holdout(rows).join(chosen, "fold").select("*", of("first").alias("a"), of("second").alias("b"))
        parts = placed(paired.drop("_scores", "first", "second"), fits, "quality")
        table = spark.createDataFrame(weights(parts.where("NOT held"), "a", "b").collect(), WEIGHTS)
    finally:
        rows.unpersist()
    held = {r["fold"] for r in oof.select("fold").distinct().collect()}
    lacking = sorted(held - {r["fold"] for r in table.select("fold").distinct().collect()})
    if lacking:
        raise ValueError(f"no rows of both classes to fit a router on without folds {lacking}")
    return policies(parts.where("held"), table, "a", "b")
