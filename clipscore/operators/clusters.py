"""K-means for many overlapping sets of rows at once: every pass over the data serves all sets and all restarts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipscore.operators.ordered import bottom_k
from clipscore.operators.routing import MIN_CLUSTER


def keyed_scalers(rows: DataFrame, vector: str, keys: str) -> DataFrame:
    """(key, n, mean, scale): mean and population deviation (1 where it is zero) of the rows of every key.

    ``keys`` is an array column: the sets that a row belongs to.  Sums form in the map tasks.
    """
    each = rows.select(F.explode(keys).alias("key"), array_to_vector(vector).alias("_x"))
    stats = each.groupBy("key").agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_x")).alias("s"))
    n = F.col("s.count").cast("double")
    spread = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(F.greatest(v, F.lit(0.0)) * (n - 1) / n))
    return stats.select(
        "key",
        F.col("s.count").alias("n"),
        vector_to_array("s.mean").alias("mean"),
        F.transform(spread, lambda x: F.when(x > 0, x).otherwise(1.0)).alias("scale"),
    )


def _sums(rows: DataFrame, vector: str, keys: str, state: dict) -> DataFrame:
    """(key, restart, cluster, n, cost, total) after dealing every row to its nearest centre in each restart of its keys.

    A task adds its rows up before anything is shuffled.
    """
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            owner, key = np.repeat(np.arange(batch.num_rows), sizes), batch.column(1).flatten().to_numpy()
            for name, (mean, scale, centers) in shared.value.items():
                z = (x[owner[key == name]] - mean) / scale
                lengths = (z**2).sum(1)[:, None]
                for r, c in enumerate(centers):
                    gaps = np.maximum(lengths - 2 * z @ c.T + (c**2).sum(1), 0)
                    near = gaps.argmin(1)
                    n, cost, total = sums.setdefault((name, r), (np.zeros(len(c)), np.zeros(len(c)), np.zeros(c.shape)))
                    n += np.bincount(near, minlength=len(c))
                    cost += np.bincount(near, gaps[np.arange(len(z)), near], len(c))
                    total += (near == np.arange(len(c))[:, None]).astype(float) @ z
        out = [(k, r, i, int(n[i]), cost[i], total[i].tolist()) for (k, r), (n, cost, total) in sums.items() for i in range(len(n)) if n[i]]
        if out:
            names = ["key", "restart", "cluster", "n", "cost", "total"]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names)

    schema = "key int, restart int, cluster int, n bigint, cost double, total array<double>"
    parts = rows.select(vector, keys).mapInArrow(run, schema)
    return parts.groupBy("key", "restart", "cluster").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")
    )


def keyed_kmeans(
    rows: DataFrame,
    vector: str,
    keys: str,
    name: str,
    clusters: int = 3,
    restarts: int = 20,
    iterations: int = 20,
    tolerance: float = 1e-4,
    min_size: int = MIN_CLUSTER,
    seed: int = 42,
) -> DataFrame:
    """One row (key, n, mean, scale, centers, cost) for every key: the restart with the lowest cost.

    Each key standardizes and clusters its own rows: no set sees rows outside it.  It has ``clusters`` clusters,
    fewer where they could not hold ``min_size`` rows each, one at least.  A restart begins with rows of the
    key that no other restart begins with while there are enough, by a hash of ``name``.  Centres are the
    means of the rows dealt to them last; an empty one stays.  All restarts of all keys advance together, so
    the passes over the data are ``iterations`` at most, whatever the numbers of keys and restarts.  What
    passes through the driver is bounded by keys, restarts, clusters and width.
    """
    spark = rows.sparkSession
    rows = rows.select(vector, keys, name).persist()
    try:
        scalers = {r.key: r for r in keyed_scalers(rows, vector, keys).collect()}
        each = rows.select(F.explode(keys).alias("key"), name, vector)
        each = each.withColumn("_h", F.xxhash64(F.lit(seed), "key", name))
        first: dict[int, list] = {}
        for r in sorted(bottom_k(each, ["key"], ["_h", name], restarts * clusters).collect(), key=lambda r: (r.key, r.rn)):
            first.setdefault(r.key, []).append(r[vector])
        state = {}
        for key, s in scalers.items():
            k = min(max(1, clusters), max(1, s.n // max(1, min_size)))
            z = (np.array(first[key]) - np.array(s.mean)) / np.array(s.scale)
            start = np.stack([z[(np.arange(k) + r * k) % len(z)] for r in range(restarts)])
            state[key] = (np.array(s.mean), np.array(s.scale), start)
        costs = dict.fromkeys(state, np.zeros(restarts))
        for _ in range(iterations if state else 0):
            moved = {key: c.copy() for key, (_, _, c) in state.items()}
            costs = {key: np.zeros(restarts) for key in state}
            for r in _sums(rows, vector, keys, state).collect():
                moved[r.key][r.restart, r.cluster] = np.array(r.total) / r.n
                costs[r.key][r.restart] += r.cost
            shift = max(((moved[key] - c) ** 2).sum(-1).max() for key, (_, _, c) in state.items())
            state = {key: (mean, scale, moved[key]) for key, (mean, scale, _) in state.items()}
            if shift <= tolerance**2:
                break
    finally:
        rows.unpersist()
    out = []
    for key, (mean, scale, centers) in sorted(state.items()):
        best = int(np.round(costs[key], 9).argmin())
        out.append((key, scalers[key].n, mean.tolist(), scale.tolist(), centers[best].tolist(), float(costs[key][best])))
    return spark.createDataFrame(out, "key int, n bigint, mean array<double>, scale array<double>, centers array<array<double>>, cost double")
