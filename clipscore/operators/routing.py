"""Condition-aware blending: weight selection, clusters, routers and routed scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipscore.functions.scores import REAL_WEIGHT, container_adjusted, mix
from clipscore.operators import metrics as M
from clipscore.operators.comparison import blended, with_grid

# Candidate weights and the smallest cluster with a policy of its own.
ALPHAS = [i / 20 for i in range(21)]
TEMPORAL_WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]
METADATA_WEIGHTS = [0.0, 0.025, 0.05, 0.075, 0.1]
MIN_CLUSTER = 40


def alpha_costs(df: DataFrame, keys: list[str], a: str, b: str, label: str = "label") -> DataFrame:
    """minDCF of every candidate blend ``alpha * a + (1 - alpha) * b`` per key, in one job.

    Equal pairs of scores are merged first, so what the grid repeats is one weighted row for each
    distinct pair; each (key, alpha) is a separate curve and the curves spread over tasks.
    """
    pairs = df.groupBy(*keys, label, a, b).agg(F.count("*").alias("_times"))
    grid = with_grid(pairs, "alpha", ALPHAS)
    grid = grid.withColumn("score", blended(F.col("alpha"), F.col(a), F.col(b)))
    return M.min_dcf(grid, [*keys, "alpha"], label, weight="_times")


def select_alpha(df: DataFrame, keys: list[str], a: str, b: str, label: str = "label") -> DataFrame:
    """Lowest (cost, alpha) per key; keys with one class only are left out."""
    costs = alpha_costs(df, keys, a, b, label).where(F.col("min_dcf").isNotNull())
    best = costs.groupBy(*keys).agg(F.min(F.struct("min_dcf", "alpha")).alias("m"))
    return best.select(*keys, F.col("m.alpha").alias("alpha"), F.col("m.min_dcf").alias("cost"))


def weight_costs(
    df: DataFrame, keys: list[str], base: str, temporal: str, status: str = "status"
) -> DataFrame:
    """minDCF of each (metadata weight, temporal weight) pair per key."""
    merged = df.groupBy(*keys, "label", base, temporal, status).agg(F.count("*").alias("_times"))
    rows = with_grid(merged, "m", METADATA_WEIGHTS)
    rows = with_grid(rows, "t", TEMPORAL_WEIGHTS)
    pulled = F.when(F.col(status) == "consistent", F.col(base) * (1.0 - F.col("m")))
    score = blended(F.col("t"), F.col(temporal), pulled.otherwise(F.col(base)))
    rows = rows.withColumn("score", score)
    return M.min_dcf(rows, [*keys, "m", "t"], weight="_times")


def select_weights(
    df: DataFrame, keys: list[str], base: str, temporal: str, status: str = "status"
) -> DataFrame:
    """Lowest cost; ties prefer an even temporal split, then the usual metadata weight, then the
    earlier grid point."""
    m, t = F.col("m"), F.col("t")
    order = F.struct(
        "min_dcf", F.abs(t - 0.5).alias("dt"), F.abs(m - REAL_WEIGHT).alias("dm"), "m", "t"
    )
    best = weight_costs(df, keys, base, temporal, status).groupBy(*keys).agg(F.min(order).alias("o"))
    return best.select(
        *keys,
        F.col("o.t").alias("temporal_weight"),
        F.col("o.m").alias("metadata_weight"),
        F.col("o.min_dcf").alias("cost"),
    )


def scaler(df: DataFrame, vector: str) -> DataFrame:
    """One row (mean, scale): per-element mean and population deviation; 1 where it is zero."""
    stats = df.select(array_to_vector(F.col(vector)).alias("v")).agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")
    )
    n = F.col("s.count").cast("double")
    spread = F.transform(
        vector_to_array("s.variance"), lambda v: F.sqrt(F.greatest(v, F.lit(0.0)) * (n - 1) / n)
    )
    return stats.select(
        vector_to_array("s.mean").alias("mean"),
        F.transform(spread, lambda x: F.when(x > 0, x).otherwise(1.0)).alias("scale"),
    )


def standardized(df: DataFrame, stats: DataFrame, vector: str, name: str) -> DataFrame:
    """Apply a scaler row as columns; the row is a scalar subquery, fixed in size."""
    one = stats.select(F.struct("mean", "scale").alias("s")).scalar()
    centred = F.zip_with(vector, "_s.mean", lambda x, m: x - m)
    out = df.withColumn("_s", one)
    return out.withColumn(name, F.zip_with(centred, "_s.scale", lambda x, s: x / s)).drop("_s")


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean vector per cluster."""
    vec = array_to_vector(F.col(vector))
    return df.groupBy(F.col(cluster).alias("cluster")).agg(
        vector_to_array(Summarizer.mean(vec)).alias("center")
    )


def nearest(df: DataFrame, centers: DataFrame, vector: str, name: str = "cluster") -> DataFrame:
    """Index of the nearest centroid by squared distance, lowest index on ties.

    Centroids are few (the cluster count is a model parameter), so they ride along as one array.
    """
    table = centers.agg(F.array_sort(F.collect_list(F.struct("cluster", "center"))).alias("c"))

    def distance(center: Column) -> Column:
        gaps = F.zip_with(vector, center, lambda x, c: (x - c) * (x - c))
        return F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g)

    near = F.array_min(
        F.transform(
            "_c", lambda c: F.struct(distance(c["center"]).alias("d"), c["cluster"].alias("cluster"))
        )
    )
    out = df.withColumn("_c", table.scalar()).withColumn("_n", near)
    return out.withColumn(name, F.col("_n.cluster")).drop("_c", "_n")


@dataclass
class Router:
    """Scaler row, centroids (cluster, center), weights (cluster, alpha, own) and the overall alpha."""

    stats: DataFrame
    centers: DataFrame
    alphas: DataFrame
    overall: float


def cluster_alphas(
    df: DataFrame, cluster: str, a: str, b: str, min_size: int = MIN_CLUSTER
) -> DataFrame:
    """Blend weight per cluster: its own where the cluster is large enough and holds both classes,
    the overall one otherwise.  Overall and per-cluster grids run as one job."""
    scoped = df.select(cluster, "label", a, b).withColumn(
        "scope",
        F.explode(F.array(F.col(cluster).cast("long"), F.lit(None).cast("long"))),
    )
    scoped = scoped.withColumn("scope", F.coalesce("scope", F.lit(-1)))
    best = select_alpha(scoped, ["scope"], a, b)
    overall = best.where("scope = -1").select("alpha").scalar()
    facts = df.groupBy(F.col(cluster).cast("long").alias("scope")).agg(
        F.count("*").alias("size"), (F.min("label") != F.max("label")).alias("both")
    )
    joined = facts.join(best.select("scope", F.col("alpha").alias("own_alpha")), "scope", "left")
    own = (F.col("size") >= min_size) & F.col("both")
    return joined.withColumn("overall", overall).select(
        F.col("scope").cast("int").alias("cluster"),
        "size",
        own.alias("own"),
        F.when(own, F.col("own_alpha")).otherwise(F.col("overall")).alias("alpha"),
        "overall",
    )


def fit_router(
    df: DataFrame,
    cluster: str,
    vector: str,
    a: str,
    b: str,
    centers: DataFrame | None = None,
    stats: DataFrame | None = None,
    min_size: int = MIN_CLUSTER,
) -> Router:
    """Router for a supplied partition; centroids and scaler come from the rows unless given."""
    stats = scaler(df, vector) if stats is None else stats
    if centers is None:
        centers = centroids(standardized(df, stats, vector, "_z"), cluster, "_z")
    table = cluster_alphas(df, cluster, a, b, min_size)

    def fixed(part: DataFrame) -> DataFrame:
        """Fitted state is one row per cluster; held as values, scoring does not refit it."""
        return df.sparkSession.createDataFrame(part.collect(), part.schema)

    table = fixed(table)
    first = table.first()
    if first is None:
        raise ValueError("no rows to fit a router on")
    alphas = table.select("cluster", "alpha", "own", "size")
    return Router(fixed(stats), fixed(centers), alphas, first["overall"])


def routed(df: DataFrame, router: Router, vector: str, a: str, b: str) -> DataFrame:
    """Add ``cluster``, ``alpha`` and ``routed``.  A cluster without a weight uses the overall one;
    the cluster-to-weight lookup is a few rows and broadcast on their own size estimate."""
    scaled = standardized(df, router.stats, vector, "_z")
    placed = nearest(scaled, router.centers, "_z").drop("_z")
    known = placed.join(router.alphas.select("cluster", "alpha"), "cluster", "left")
    alpha = F.coalesce("alpha", F.lit(router.overall))
    return known.withColumn("alpha", alpha).withColumn(
        "routed", mix(F.col("alpha"), F.col(a), F.col(b))
    )


def router_summary(df: DataFrame, cluster: str, a: str, b: str, min_size: int = MIN_CLUSTER) -> DataFrame:
    """In-sample minDCF of the overall blend and of the cluster-wise blend, in one row."""
    table = cluster_alphas(df, cluster, a, b, min_size)
    rows = df.join(table.withColumnRenamed("cluster", cluster), cluster)
    both = rows.select(
        "label",
        F.explode(
            F.create_map(
                F.lit("overall"), blended(F.col("overall"), F.col(a), F.col(b)),
                F.lit("conditional"), blended(F.col("alpha"), F.col(a), F.col(b)),
            )
        ).alias("policy", "score"),
    )
    return M.min_dcf(both, ["policy"]).select("policy", "min_dcf")


def explain_blend(
    df: DataFrame, parts: dict[str, float], status: str = "status", real_weight: float = REAL_WEIGHT
) -> DataFrame:
    """Component scores and weights, the audio score they sum to, and the container adjustment."""
    audio = F.lit(0.0)
    for column, weight in parts.items():
        audio = audio + F.lit(weight) * F.col(column)
    components = F.array(
        *[
            F.struct(F.lit(c).alias("model"), F.lit(w).alias("weight"), F.col(c).alias("audio_score"))
            for c, w in parts.items()
        ]
    )
    rows = df.withColumn("audio_score", audio).withColumn("component_scores", components)
    return rows.withColumn(
        "score", container_adjusted(F.col("audio_score"), F.col(status), real_weight)
    ).withColumn("metadata_adjustment", F.col("score") - F.col("audio_score"))


