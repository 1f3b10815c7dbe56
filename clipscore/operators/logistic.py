"""Logistic models of many overlapping training sets: every pass over the data serves all sets and all settings.

As in ``operators/penalty.py`` every (set, model) walks on its own and a pass answers all walks at once.  A task takes
the scores of all models on its rows in one product and their gradients in another; what passes through the
driver is bounded by sets, models and columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipscore.functions.vectors import pick
from clipscore.operators.clusters import keyed_scalers
from clipscore.operators.joins import class_weights
from clipscore.operators.models import Fitted, Spec
from clipscore.operators.penalty import _members, _vectors, minimise, together
from clipscore.session import ship

TOLERANCE = 1e-9  # relative; passes are shared, so the last ones cost little
_ROWS = 2048  # whose scores under all models a task holds at once

View = tuple[str, tuple[int, ...]]


def _view(spec: Spec) -> View:
    return spec.view, spec.columns


def _vector(view: View):
    name, columns = view
    return pick(F.col(name), list(columns)) if columns else F.col(name)


class Lines:
    """Fitted models by (set, name)."""

    def __init__(self, models: dict[tuple[int, str], Fitted]):
        self.models = models

    def scores(self, rows: DataFrame, keys: str, sets: list[int], keep: tuple[str, ...] = ("clip_id", "label", "grp")) -> DataFrame:
        """(keep, score, key, model): every row under all models of those of its ``keys`` that are among ``sets``."""
        views = sorted({_view(m.spec) for m in self.models.values()})
        by: dict[int, list] = {}
        for (key, name), m in sorted(self.models.items()):
            if key in sets:
                by.setdefault(key, []).append((name, views.index(_view(m.spec)), np.array(m.mean), np.array(m.scale), np.array(m.line[0]), m.line[1]))
        ship(rows.sparkSession)
        shared = rows.sparkSession.sparkContext.broadcast(by)
        named = [_vector(v).alias(f"_v{i}") for i, v in enumerate(views)]
        wanted = F.filter(keys, lambda k: k.isin(list(map(int, sets)))).alias("_keys")
        some = rows.where(F.size(wanted) > 0).select(*named, wanted, *keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = len(views)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, (owner, key) = [_vectors(batch, i) for i in range(at)], _members(batch, at)
                for k in np.unique(key):
                    own = owner[key == k]
                    ids = [batch.column(at + 1 + i).take(pa.array(own)) for i in range(len(keep))]
                    for name, view, mean, scale, w, b in shared.value[int(k)]:
                        with np.errstate(over="ignore"):
                            score = 1 / (1 + np.exp(-((x[view][own] - mean) / scale @ w + b)))
                        made = [pa.array(score), pa.array(np.full(len(own), k, dtype=np.int32)), pa.array([name] * len(own))]
                        yield pa.RecordBatch.from_arrays([*ids, *made], [*keep, "score", "key", "model"])

        kinds = dict(rows.dtypes)
        schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "score double, key int, model string"])
        return some.mapInArrow(run, schema)


def keyed_logistic(rows: DataFrame, keys: str, specs: Mapping[int, Mapping[str, Spec]], label: str = "label") -> Lines:
    """The logistic models ``specs`` (set -> name -> spec), each the minimum that ``fit`` seeks on the rows of its set.

    ``keys`` is an array column: the sets that a row trains.  Each set standardizes and weights its own rows alone.
    ``rows`` are read once a pass and should be persisted.  A set without rows is an error; one of a single class has
    that class for certain, as in Spark ML.
    """
    spark = rows.sparkSession
    ship(spark)
    views = sorted({_view(s) for of in specs.values() for s in of.values()})
    counts: dict[int, dict[int, int]] = {}
    per = rows.select(F.explode(keys).alias("key"), F.col(label).cast("int").alias("label"))
    for r in per.groupBy("key", "label").count().collect():  # two rows a set
        counts.setdefault(r.key, {})[r.label] = r["count"]
    lacking = sorted(k for k in specs if k not in counts)
    if lacking:
        raise ValueError(f"training sets without rows: {lacking[:5]}")
    scalers = {}
    for i, v in enumerate(views):
        for s in keyed_scalers(rows.select(_vector(v).alias("_v"), F.col(keys).alias("_keys")), "_v", "_keys").collect():
            scalers[i, s.key] = (np.array(s["mean"]), np.array(s["scale"]))
    out, walks, facts = {}, {}, {}
    for key, of in specs.items():
        real, spoof = counts[key].get(0, 0), counts[key].get(1, 0)
        for name, spec in of.items():
            mean, scale = scalers[views.index(_view(spec)), key]
            out[key, name] = Fitted(spec, mean.tolist(), scale.tolist())
            if not real or not spoof:
                out[key, name].line = ([0.0] * len(mean), float("inf") if spoof else float("-inf"))
                continue
            weights = class_weights(spec.weighting, real, spoof)
            total = weights[0] * real + weights[1] * spoof
            ridge = np.append(np.full(len(mean), 1 / (spec.c * total)), 0.0)
            start = np.append(np.zeros(len(mean)), np.log(weights[1] * spoof / (weights[0] * real)))
            facts[key, name] = (views.index(_view(spec)), mean, scale, weights, total)
            walks[key, name] = minimise(start, ridge, 2 * spec.iterations, TOLERANCE, 30)
    # Rows are centred where the sets' means are, so that no product of large numbers cancels.
    centres = [np.mean([m for (j, _), (m, _) in scalers.items() if j == i], axis=0) for i in range(len(views))]
    data = rows.select(*[_vector(v).alias(f"_v{i}") for i, v in enumerate(views)], keys, F.col(label).cast("int"))
    found = together(walks, lambda points: _losses(data, facts, centres, points))
    for name, w in found.items():
        out[name].line = (w[:-1].tolist(), float(w[-1]))
    return Lines(out)


def _losses(data: DataFrame, facts: dict, centres: list[np.ndarray], points: dict) -> dict:
    """(loss, gradient) of every asked (set, name) at its point.  A task adds its rows up before anything is shuffled."""
    asked = sorted(points)
    views = sorted({facts[a][0] for a in asked})
    sets = np.unique([key for key, _ in asked])
    groups = []
    for v in views:
        of = [i for i, a in enumerate(asked) if facts[a][0] == v]
        slope = np.stack([points[asked[i]][:-1] / facts[asked[i]][2] for i in of], axis=1)
        gap = np.stack([centres[v] - facts[asked[i]][1] for i in of], axis=1)
        level = np.array([points[asked[i]][-1] for i in of]) + (gap * slope).sum(0)
        weight = np.array([facts[asked[i]][3] for i in of]).T
        groups.append((v, of, slope, level, weight, np.searchsorted(sets, [asked[i][0] for i in of])))
    at = len(centres)
    shared = data.sparkSession.sparkContext.broadcast((groups, sets, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, sets, centres = shared.value
        sums = {i: np.zeros(len(slope) + 2) for _, of, slope, *_ in groups for i in of}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            owner, key = _members(batch, at)
            place = np.minimum(np.searchsorted(sets, key), len(sets) - 1)
            known = sets[place] == key
            member = np.zeros((n, len(sets)))
            member[owner[known], place[known]] = 1.0
            label = batch.column(at + 1).to_numpy()
            for v, of, slope, level, weight, of_set in groups:
                whole = _vectors(batch, v)
                parts = np.zeros((len(slope) + 2, len(of)))
                for i in range(0, n, _ROWS):
                    x, one = whole[i : i + _ROWS] - centres[v], (label[i : i + _ROWS] == 1)[:, None]
                    z = x @ slope + level
                    times = member[i : i + _ROWS, of_set] * np.where(one, weight[1], weight[0])
                    small = np.exp(-np.abs(z))
                    parts[0] += (times * (np.maximum(np.where(one, -z, z), 0.0) + np.log1p(small))).sum(0)
                    pull = times * (np.where(z >= 0, 1.0, small) / (1.0 + small) - one)
                    parts[1] += pull.sum(0)
                    parts[2:] += x.T @ pull
                for j, i in enumerate(of):
                    sums[i] += parts[:, j]
        made = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.int32()), pa.array([sums[i].tolist() for i in made], pa.list_(pa.float64()))], ["at", "part"])

    parts = data.mapInArrow(run, "at int, part array<double>")
    whole = parts.groupBy("at").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part")).collect()
    shared.destroy()
    out = {}
    for r in whole:
        v, mean, scale, _, total = facts[asked[r["at"]]]
        part = np.array(r["part"]) / total
        out[asked[r["at"]]] = part[0], np.append((part[2:] + (centres[v] - mean) * part[1]) / scale, part[1])
    return out
