"""Penalty paths of kernel machines on many overlapping training sets: every pass over the data serves all sets.

Every (set, penalty) walks on its own.  The walks are generators that ask for loss and gradient at a point; a pass
answers all of them at once and forms the random features of a row once for all penalties of a set.  What passes
through the driver is bounded by sets, penalties and random features.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipscore.operators.clusters import keyed_scalers
from clipscore.operators.joins import class_weights
from clipscore.operators.models import Spec, fourier_basis, spread

Walk = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]
ROUNDING = 0.1  # width of the parabola that rounds the hinge's corner
MEMORY = 30  # moves that a walk remembers: weak penalties take half the passes that they take with ten
_ROWS = 256  # whose features a task holds at once


def _direction(g: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the inverse curvature of the remembered (move, change of gradient) pairs, times ``g``."""
    d, used = -g, []
    for s, y in reversed(steps):
        a = (s @ d) / (s @ y)
        d = d - a * y
        used.append((a, s, y))
    if steps:
        s, y = steps[-1]
        d = d * (s @ y) / (y @ y)
    for a, s, y in reversed(used):
        d = d + (a - (y @ d) / (s @ y)) * s
    return d


def minimise(w: np.ndarray, ridge: np.ndarray, iterations: int = 100, tolerance: float = 1e-6, memory: int = 10) -> Walk:
    """Limited-memory quasi-Newton descent (Nocedal 1980) with halved steps on loss + w * ridge * w / 2.

    Yields the points at which it wants (loss, gradient); returns the last accepted point.
    """

    def penalised(w: np.ndarray, answer: tuple[float, np.ndarray]) -> tuple[float, np.ndarray]:
        return answer[0] + 0.5 * (ridge * w) @ w, answer[1] + ridge * w

    f, g = penalised(w, (yield w))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        d = _direction(g, steps)
        slope = d @ g
        if slope > -1e-18:
            break
        length = 1.0 if steps else min(1.0, 1.0 / np.sqrt(g @ g))
        for _ in range(30):
            trial = w + length * d
            ft, gt = penalised(trial, (yield trial))
            if ft <= f + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        s, y = trial - w, gt - g
        if s @ y > 1e-14:
            steps = [*steps, (s, y)][-memory:]
        small = f - ft <= tolerance * max(abs(f), 1e-12)
        w, f, g = trial, ft, gt
        if small:
            break
    return w


def minimise_cornered(w: np.ndarray, ridge: np.ndarray, iterations: int, tolerance: float, memory: int, patience: int = 5) -> Walk:
    """As ``minimise``, for a loss with corners: steps are halved or grown until the slope has weakened as well (Lewis and
    Overton 2013), a direction without such a step is followed by the gradient's, and ``patience`` small steps in turn are
    the end.  One halved step says little there: it may have met a corner.
    """

    def penalised(w: np.ndarray, answer: tuple[float, np.ndarray]) -> tuple[float, np.ndarray]:
        return answer[0] + 0.5 * (ridge * w) @ w, answer[1] + ridge * w

    f, g = penalised(w, (yield w))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    still = 0
    for _ in range(iterations):
        d = _direction(g, steps)
        slope = d @ g
        if slope > -1e-18:
            break
        length, low, high, found = 1.0 if steps else min(1.0, 1.0 / np.sqrt(g @ g)), 0.0, None, None
        for _ in range(20):
            trial = w + length * d
            ft, gt = penalised(trial, (yield trial))
            if ft > f + 1e-4 * length * slope:
                high = length
            else:
                low, found = length, (trial, ft, gt)
                if gt @ d >= 0.9 * slope:
                    break
            length = 2 * low if high is None else (low + high) / 2
        if found is None:
            if not steps:
                break
            steps = []
            continue
        trial, ft, gt = found
        s, y = trial - w, gt - g
        if s @ y > 1e-14:
            steps = [*steps, (s, y)][-memory:]
        still = still + 1 if f - ft <= tolerance * max(abs(f), 1e-12) else 0
        w, f, g = trial, ft, gt
        if still >= patience:
            break
    return w


def together(walks: dict, evaluate: Callable[[dict], dict]) -> dict:
    """Results of all walks.  ``evaluate`` maps the points that are asked for to (loss, gradient), in one pass."""
    wanted, done = {}, {}
    for key, walk in walks.items():
        wanted[key] = next(walk)
    while wanted:
        answers, wanted, asked = evaluate(wanted), {}, wanted
        for key in asked:
            try:
                wanted[key] = walks[key].send(answers[key])
            except StopIteration as end:
                done[key] = end.value
    return done


def _members(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of the array column ``at``."""
    column = batch.column(at)
    return np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy()


def _vectors(batch: pa.RecordBatch, at: int = 0) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


class Paths:
    """Solutions (key -> penalty x coefficients) with what a row needs to get its margins."""

    def __init__(self, sets: dict, basis: tuple[np.ndarray, np.ndarray], cs: Sequence[float], solutions: dict):
        self.sets, self.basis, self.cs, self.solutions = sets, basis, list(cs), solutions

    def margins(self, rows: DataFrame, vector: str, keys: str, name: str, label: str) -> DataFrame:
        """(name, label, key, c, margin) of every row for each of its ``keys`` and each penalty."""
        shared = rows.sparkSession.sparkContext.broadcast((self.sets, self.basis, self.solutions))
        cs = np.array(self.cs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets, basis, solutions = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, (owner, key) = _vectors(batch), _members(batch, 1)
                for k in np.unique(key):
                    own, w = owner[key == k], solutions[k]
                    blocks = [_projected(x[own[i : i + _ROWS]], sets[k], basis) @ w[:, :-1].T for i in range(0, len(own), _ROWS)]
                    margin = np.concatenate(blocks) + w[:, -1]
                    each = pa.array(np.repeat(own, len(cs)))
                    flat = [pa.array(np.full(margin.size, k, dtype=np.int32)), pa.array(np.tile(cs, len(own))), pa.array(margin.ravel())]
                    yield pa.RecordBatch.from_arrays([batch.column(2).take(each), batch.column(3).take(each), *flat], [name, label, "key", "c", "margin"])

        kinds = dict(rows.dtypes)
        schema = f"`{name}` {kinds[name]}, `{label}` {kinds[label]}, key int, c double, margin double"
        return spread(rows.select(vector, keys, name, label)).mapInArrow(run, schema)


def _projected(x: np.ndarray, scale: tuple, basis: tuple[np.ndarray, np.ndarray], fitting: bool = False) -> np.ndarray:
    """Random features in doubles.  While ``fitting``, angles are brought to one turn in doubles and their cosines taken
    in single precision (an error of 1e-7, far below a fit's tolerance), an order of magnitude faster."""
    w, b = basis
    angle = (x - scale[0]) / scale[1] @ w + b
    if fitting:
        turns = np.rint(angle * (0.5 / np.pi))
        turns *= 2.0 * np.pi
        angle -= turns
        z = np.cos(angle.astype(np.float32)).astype(np.float64)
    else:
        z = np.cos(angle)
    z *= np.sqrt(2.0 / len(b))
    return z


def _losses(rows: DataFrame, columns: list[str], static, points: dict) -> dict:
    """(loss, gradient) of every asked (set, penalty) at its point.  A task adds its rows up before anything is shuffled."""
    asked: dict[int, tuple[list[int], np.ndarray]] = {}
    for k in sorted({k for k, _ in points}):
        of = sorted(i for s, i in points if s == k)
        asked[k] = (of, np.stack([points[k, i] for i in of], axis=1))
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, basis, rounding = static.value
        sums = {k: np.zeros((len(of), len(w) + 1)) for k, (of, w) in shared.value.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, (owner, key) = _vectors(batch), _members(batch, 1)
            label = batch.column(2).to_numpy()
            for k, (of, w) in shared.value.items():
                every, part, (real, spoof) = owner[key == k], sums[k], sets[k][2][:, of]
                for start in range(0, len(every), _ROWS):
                    own = every[start : start + _ROWS]
                    z, one = _projected(x[own], sets[k], basis, True), label[own]
                    sign = (2.0 * one - 1.0)[:, None]
                    gap = 1.0 - sign * (z @ w[:-1] + w[-1])
                    weight = np.where(one[:, None] == 1, spoof, real)
                    # The hinge with a parabola of the given width in place of its corner.
                    if rounding:
                        inside = np.clip(gap, 0.0, rounding) / rounding
                        part[:, 0] += (weight * (inside**2 * (rounding / 2) + np.maximum(gap - rounding, 0.0))).sum(0)
                    else:
                        inside = (gap > 0.0).astype(float)
                        part[:, 0] += (weight * np.maximum(gap, 0.0)).sum(0)
                    pull = -weight * sign * inside
                    part[:, 1:-1] += pull.T @ z
                    part[:, -1] += pull.sum(0)
        flat = [(k, i, v) for k, part in sums.items() for i, v in zip(shared.value[k][0], part)]
        if flat:
            ks, at, values = zip(*flat)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(values)), len(values[0])).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(at, pa.int32()), lists], ["key", "at", "part"])

    parts = rows.select(*columns).mapInArrow(run, "key int, at int, part array<double>")
    whole = parts.groupBy("key", "at").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))
    found = whole.toArrow()
    shared.destroy()
    out = {}
    for k, i, v in zip(found["key"].to_pylist(), found["at"].to_pylist(), found["part"]):
        part = v.values.to_numpy() / static.value[0][k][3][i]
        out[k, i] = part[0], part[1:]
    return out


def keyed_paths(
    rows: DataFrame, vector: str, keys: str, label: str, cs: Sequence[float], spec: Spec, tolerance: float = 1e-5
) -> Paths:
    """Kernel machines of every set (``keys``: array of the sets that a row trains) for all penalties ``cs``.

    Each set standardizes and weights (by class, balanced) its own rows alone.  The machine is that of ``fit``:
    random features of the RBF kernel and a linear hinge machine whose penalty is 1 / (c * total weight), the
    hinge rounded over a width of 0.1.  A set without both classes is an error.  ``iterations`` of ``spec`` bounds the
    steps of each (set, penalty).
    """
    cs = sorted(set(cs))
    return keyed_machines(rows, vector, keys, label, [(c, "balanced") for c in cs], cs, spec, tolerance, ROUNDING)


def keyed_machines(
    rows: DataFrame, vector: str, keys: str, label: str, settings: Sequence[tuple[float, str]], names: Sequence[float], spec: Spec,
    tolerance: float, rounding: float = 0.0,
) -> Paths:
    """As ``keyed_paths``, for ``settings`` of (penalty, weighting); margins have the ``names`` of settings as ``c``.

    ``rounding`` is the width over which the hinge's corner is rounded; 0 is the hinge itself, whose walks take up to twice
    the steps.
    """
    spark = rows.sparkSession
    if not settings or min(c for c, _ in settings) <= 0:
        raise ValueError("penalties must be positive")
    kept = spread(rows.select(vector, keys, label)).persist()
    try:
        counts: dict[int, dict[int, int]] = {}
        per = kept.select(F.explode(keys).alias("key"), F.col(label).cast("int").alias("label"))
        for r in per.groupBy("key", "label").count().collect():  # two rows a set
            counts.setdefault(r.key, {})[r.label] = r["count"]
        lacking = sorted(k for k, n in counts.items() if not (n.get(0) and n.get(1)))
        if lacking:
            raise ValueError(f"training sets without both classes: {lacking[:5]}")
        sets = {}
        for s in keyed_scalers(kept, vector, keys).collect():
            n = counts[s.key]
            weights = np.array([class_weights(weighting, n[0], n[1]) for _, weighting in settings]).T
            sets[s.key] = (np.array(s["mean"]), np.array(s["scale"]), weights, weights[0] * n[0] + weights[1] * n[1])
        width = len(next(iter(sets.values()))[0]) if sets else 0
        basis = fourier_basis(width, spec.random_features, spec.seed) if sets else (np.zeros((0, 0)), np.zeros(0))
        static = spark.sparkContext.broadcast((sets, basis, rounding))
        free = np.append(np.ones(spec.random_features), 0.0)  # the intercept, last, is not penalised
        walks = {}
        for k, s in sets.items():
            for i, (c, _) in enumerate(settings):
                start, ridge = np.zeros(len(free)), free / (c * s[3][i])
                if rounding:
                    walks[k, i] = minimise(start, ridge, spec.iterations, tolerance, MEMORY)
                else:
                    walks[k, i] = minimise_cornered(start, ridge, 2 * spec.iterations, tolerance, 2 * MEMORY)
        found = together(walks, lambda points: _losses(kept, [vector, keys, label], static, points))
        solutions = {k: np.stack([found[k, i] for i in range(len(settings))]) for k in sets}
    finally:
        kept.unpersist()
    return Paths(sets, basis, names, solutions)


def keyed_sigmoids(margins: DataFrame, keys: list[str], label: str = "label", margin: str = "margin", platt: bool = True) -> DataFrame:
    """(keys, a, b) of sigmoids 1 / (1 + exp(-(a * margin + b))) with Platt's targets (else the labels), all keys in the same
    passes."""
    one = F.col(label) == 1
    counts = margins.groupBy(*keys).agg(F.count_if(one).alias("_n1"), F.count_if(~one).alias("_n0"))
    sizes = {tuple(r[k] for k in keys): (r["_n0"], r["_n1"]) for r in counts.collect()}
    spark, kinds = margins.sparkSession, dict(margins.dtypes)
    names = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    fields = f"{names}, a double, b double, t0 double, t1 double"

    def evaluate(points: dict) -> dict:
        ends = {k: (1 / (n0 + 2), (n1 + 1) / (n1 + 2)) if platt else (0.0, 1.0) for k, (n0, n1) in sizes.items()}
        asked = [(*k, float(w[0]), float(w[1]), *ends[k]) for k, w in points.items()]
        z = F.col("a") * F.col(margin) + F.col("b")
        target = F.when(one, F.col("t1")).otherwise(F.col("t0"))
        off = 1 / (1 + F.exp(-z)) - target
        loss: Column = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - target * z
        met = margins.join(spark.createDataFrame(asked, fields), keys)
        found = met.groupBy(*keys).agg(F.avg(loss).alias("f"), F.avg(off * F.col(margin)).alias("ga"), F.avg(off).alias("gb"))
        return {tuple(r[k] for k in keys): (r["f"], np.array([r["ga"], r["gb"]])) for r in found.collect()}

    walks = {k: minimise(np.array([0.0, np.log((n1 + 1) / (n0 + 1))]), np.zeros(2), 50, 1e-7) for k, (n0, n1) in sizes.items()}
    found = together(walks, evaluate)
    rows = [(*k, float(w[0]), float(w[1])) for k, w in found.items()]
    return spark.createDataFrame(rows, f"{names}, a double, b double")
