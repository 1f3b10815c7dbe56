"""Classifiers on feature vectors: specs, fits, out-of-fold scores, explanations.

Rows are (clip_id, label, grp, v) with ``v`` an array of doubles.  Every fit and every scoring pass
is a distributed Spark ML job; the driver only walks the short list of models and folds.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipscore.functions.vectors import dot, pick
from clipscore.operators import metrics as M
from clipscore.operators.clusters import keyed_kmeans
from clipscore.operators.comparison import select_model
from clipscore.operators.joins import with_class_weights
from clipscore.operators.ordered import ranked
from clipscore.operators.routing import MIN_CLUSTER, Router, fit_router, nearest, scaler, standardized
from clipscore.session import ship
from clipscore.sources import checks


@dataclass(frozen=True)
class Spec:
    """One model: its view, family (logistic, svm, forest, trees) and settings."""

    name: str
    family: str = "logistic"
    view: str = "v"
    c: float = 1.0
    weighting: str = "balanced"
    trees: int = 300
    depth: int = 12
    columns: tuple[int, ...] = ()
    random_features: int = 512
    iterations: int = 100
    seed: int = 42


# The ten compared models, in the order that decides ties.
COMPARISON = (
    Spec("logistic_204", "logistic", "base_lfcc", 0.1),
    Spec("rbf_svm_204", "svm", "base_lfcc", 1.0),
    Spec("rbf_svm_c0_3_204", "svm", "base_lfcc", 0.3),
    Spec("rbf_svm_c3_204", "svm", "base_lfcc", 3.0),
    Spec("cost_logistic_204", "logistic", "base_lfcc", 0.1, "cost"),
    Spec("cost_rbf_svm_204", "svm", "base_lfcc", 1.0, "cost"),
    Spec("cost_rbf_svm_c0_3_204", "svm", "base_lfcc", 0.3, "cost"),
    Spec("cost_rbf_svm_c3_204", "svm", "base_lfcc", 3.0, "cost"),
    Spec("logistic_temporal", "logistic", "temporal", 0.1),
    Spec("extra_trees_base", "trees", "base", trees=300),
)
SVM_CS = (0.1, 0.3, 1.0, 3.0, 10.0)
_PROJECTED_ROWS = 256  # whose angles a task holds beside its batch
_LEAST_ROWS, _MOST_ROWS = 32_768, 65_536  # of a task of a fit
_MOST_NODES = 500_000  # of trees that are grown together
_WALKED_ROWS = 2048  # that a task takes through a tree at once


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores: they are small, so partitions by size would leave the work on them to a few tasks."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def _dealt(rows: DataFrame, count: int, spec: Spec) -> DataFrame:
    """Training rows dealt for a fit: to all cores, and to further tasks beyond 65,536 rows each.  A pass of a linear
    model over few rows costs less than a task, so its tasks have 32,768 rows where that takes fewer."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if spec.family in ("logistic", "svm"):
        cores = min(cores, -(-count // _LEAST_ROWS))
    return rows.repartition(max(1, cores, -(-count // _MOST_ROWS)))


def fourier_basis(width: int, features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases of random Fourier features of the RBF kernel with gamma = 1 / width."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, math.sqrt(2.0 / width), (width, features)), rng.uniform(0.0, 2 * math.pi, features)


def random_fourier(vector: Column, width: int, features: int, seed: int) -> Column:
    """Random Fourier features of the RBF kernel with gamma = 1 / width on standardized input
    (Rahimi and Recht 2007): sqrt(2/D) cos(Wx + b), one matrix product per Arrow batch."""
    w, b = fourier_basis(width, features, seed)

    @F.arrow_udf("array<double>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)
            out = np.empty((len(x), features))
            for i in range(0, len(x), _PROJECTED_ROWS):
                part = rows[i : i + _PROJECTED_ROWS] @ w + b
                np.cos(part, out=out[i : i + _PROJECTED_ROWS])
            out *= math.sqrt(2.0 / features)
            ends = np.arange(0, out.size + 1, features, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return project(vector)


@dataclass(frozen=True)
class Trees:
    """A forest as flat arrays, one tree after the other.

    ``value`` is an inner node's threshold or a leaf's share of the synthetic class; both children of a leaf are the leaf.
    """

    roots: np.ndarray
    child: np.ndarray  # left and right, by turns
    feature: np.ndarray
    value: np.ndarray
    depth: int

    def ends(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The leaf of every row, tree after tree."""
        flat, start = x.ravel(), np.arange(len(x)) * x.shape[1]
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = self.child[2 * at + ~(flat[start + self.feature[at]] <= self.value[at])]
            yield at

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Mean share of the synthetic class."""
        total = np.zeros(len(x))
        for at in self.ends(x):
            total += self.value[at]
        return total / len(self.roots)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(row, tree): the number of the leaf among the tree's, in the order of nodes."""
        is_leaf = self.child[::2] == np.arange(len(self.value))
        before = np.cumsum(is_leaf) - is_leaf
        return np.stack([before[at] - before[root] for root, at in zip(self.roots, self.ends(x))], axis=1)


@dataclass(frozen=True)
class Kept:
    """A part of a forest that lies in the shared folder and not on the driver."""

    path: str
    getNumTrees: int
    featureImportances: Vector

    @staticmethod
    def of(model: RandomForestClassificationModel) -> Kept:
        path = shared_path(SparkSession.active())
        model.write().overwrite().save(path)
        return Kept(path, model.getNumTrees, model.featureImportances)

    def write(self):
        return RandomForestClassificationModel.load(self.path).write()


@dataclass
class Fitted:
    """A fitted model: scaler row, Spark ML model or (coefficients, intercept), and for margins a sigmoid.

    A large forest is several models (``model`` and ``more``), each ``Kept`` with a part of the trees.
    """

    spec: Spec
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    model: object = None
    sigmoid: tuple[float, float] | None = None
    line: tuple[list[float], float] | None = None
    more: list = field(default_factory=list)

    @property
    def forests(self) -> list:
        return [self.model, *self.more]

    @cached_property
    def trees(self):
        """The forest's arrays, as a broadcast: a model that tasks get in their closure is made anew in every task."""
        spark = SparkSession.active()
        parts = [_table(m).toArrow() for m in self.forests]
        return spark.sparkContext.broadcast(_packed(parts, self.spec.depth))

    def _walked(self, df: DataFrame, kind: str, walk) -> Column:
        """What ``walk`` makes of the forest and of the rows' vectors, in Arrow tasks."""
        shared = self.trees

        @F.arrow_udf(kind)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for x in batches:
                rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 1))
                starts = range(0, max(1, len(rows)), _WALKED_ROWS)
                out = np.concatenate([walk(shared.value, rows[i : i + _WALKED_ROWS]) for i in starts])
                if out.ndim == 1:
                    yield pa.array(out)
                else:
                    ends = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
                    yield pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel().astype(np.int32)))

        ship(df.sparkSession)
        return run(self.vector())

    def vector(self) -> Column:
        v = F.col(self.spec.view)
        return pick(v, list(self.spec.columns)) if self.spec.columns else v

    def inputs(self, df: DataFrame) -> DataFrame:
        """Add the model's input vector ``_x``."""
        v = self.vector()
        if self.spec.family in ("forest", "trees"):
            return df.withColumn("_x", array_to_vector(v))
        z = F.zip_with(v, F.array(*map(F.lit, self.mean)), lambda x, m: x - m)
        z = F.zip_with(z, F.array(*map(F.lit, self.scale)), lambda x, s: x / s)
        if self.spec.family == "svm":
            z = random_fourier(z, len(self.mean), self.spec.random_features, self.spec.seed)
        return df.withColumn("_x", array_to_vector(z))

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Add the probability of the synthetic class."""
        made = {"_x", "rawPrediction", "probability", "prediction"}
        if self.line is not None:
            out = self.inputs(df)
            z = dot(vector_to_array("_x"), F.array(*map(F.lit, self.line[0]))) + F.lit(self.line[1])
            return out.withColumn(name, 1.0 / (1.0 + F.exp(-z))).drop(*made)
        if self.spec.family in ("forest", "trees"):
            return df.withColumn(name, self._walked(df, "double", Trees.shares))
        out = self.model.transform(self.inputs(df))
        if self.sigmoid is None:
            value = F.get(vector_to_array("probability"), 1)
        else:
            a, b = self.sigmoid
            margin = F.get(vector_to_array("rawPrediction"), 1)
            value = 1.0 / (1.0 + F.exp(-(F.lit(a) * margin + F.lit(b))))
        return out.withColumn(name, value).drop(*made)

    def margin(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self.inputs(df))
        return out.withColumn("margin", F.get(vector_to_array("rawPrediction"), 1)).drop(
            "_x", "rawPrediction", "prediction"
        )

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        if self.line is None:
            self.model.write().overwrite().save(f"{path}/model")
        for i, model in enumerate(self.more):
            model.write().overwrite().save(f"{path}/more={i}")
        row = {"spec": asdict(self.spec), "mean": self.mean, "scale": self.scale, "sigmoid": self.sigmoid, "line": self.line}
        row["more"] = len(self.more)
        lines = spark.createDataFrame([(json.dumps(row),)], "value string")
        lines.write.mode("overwrite").text(f"{path}/bundle")

    @staticmethod
    def load(path: str) -> Fitted:
        spark = SparkSession.active()
        row = json.loads(spark.read.text(f"{path}/bundle").first()[0])
        row["spec"]["columns"] = tuple(row["spec"]["columns"])
        spec = Spec(**row["spec"])
        sigmoid = tuple(row["sigmoid"]) if row["sigmoid"] else None
        if row.get("line"):
            return Fitted(spec, row["mean"], row["scale"], sigmoid=sigmoid, line=(row["line"][0], row["line"][1]))
        kinds = {"logistic": LogisticRegressionModel, "svm": LinearSVCModel}
        kind = kinds.get(spec.family, RandomForestClassificationModel)
        if row.get("more"):
            parts = [Kept.of(kind.load(f"{path}/{p}")) for p in ("model", *[f"more={i}" for i in range(row["more"])])]
            return Fitted(spec, model=parts[0], more=parts[1:])
        return Fitted(spec, row["mean"], row["scale"], kind.load(f"{path}/model"), sigmoid)


def _estimator(spec: Spec, total_weight: float):
    common = {"featuresCol": "_x", "labelCol": "label", "weightCol": "_w"}
    if spec.family == "logistic":
        return LogisticRegression(
            regParam=1 / (spec.c * total_weight), elasticNetParam=0.0, standardization=False,
            maxIter=2 * spec.iterations, **common,
        )
    if spec.family == "svm":
        return LinearSVC(
            regParam=1 / (spec.c * total_weight), standardization=False, maxIter=spec.iterations, **common
        )
    return RandomForestClassifier(
        numTrees=spec.trees, maxDepth=spec.depth, minInstancesPerNode=2, featureSubsetStrategy="sqrt",
        bootstrap=spec.family == "forest", seed=spec.seed, cacheNodeIds=True, **common,
    )


def _weighted(df: DataFrame, spec: Spec) -> DataFrame:
    column = "cost_weight" if spec.weighting == "cost" else "balanced"
    return with_class_weights(df).withColumn("_w", F.col(column)).drop("balanced", "cost_weight")


def fit(df: DataFrame, spec: Spec, calibrate: bool = True) -> Fitted:
    """Fit on the given rows alone: scaler, weights and model see nothing else.

    Margins become probabilities through a sigmoid fitted on internal three-fold scores.
    """
    out = Fitted(spec)
    if spec.family in ("logistic", "svm"):
        columns = list(spec.columns)
        v = pick(F.col(spec.view), columns) if columns else F.col(spec.view)
        row = scaler(df.select(v.alias("v")), "v").first()
        out.mean, out.scale = list(row["mean"]), list(row["scale"])
    rows = _weighted(df, spec).select(spec.view, "label", "_w")
    n, total = rows.agg(F.count("*"), F.sum("_w")).first()
    train = out.inputs(_dealt(rows, n, spec)).select("_x", "label", "_w")
    if spec.family == "svm" and calibrate:
        out.model, out.sigmoid = parallel(
            [lambda: _estimator(spec, total).fit(train), lambda: _sigmoid(df, spec)]
        )
    elif spec.family in ("forest", "trees"):
        out.model, *out.more = _grown(_planted(spec, n), train, total)
    else:
        out.model = _estimator(spec, total).fit(train)
    return out


def _grown(parts: list[Spec], train: DataFrame, total: float) -> list:
    """The parts of a forest, two at a time."""
    if len(parts) == 1:
        return [_estimator(parts[0], total).fit(train)]
    train = train.persist()
    try:
        return parallel([lambda s=s: Kept.of(_estimator(s, total).fit(train)) for s in parts], workers=2)
    finally:
        train.unpersist()


def _planted(spec: Spec, rows: int) -> list[Spec]:
    """Parts of a forest that are grown one by one.  What a fit keeps of a row grows with its trees, and its nodes stand
    on the driver while it lasts: they are at most ``_MOST_NODES``."""
    most = max(1, _MOST_NODES // max(1, min(2 ** (spec.depth + 1), rows)))
    count = -(-spec.trees // most)
    sizes = [spec.trees // count + (i < spec.trees % count) for i in range(count)]
    return [replace(spec, trees=n, seed=spec.seed + 1_000_003 * i) for i, n in enumerate(sizes)]


@dataclass(frozen=True)
class Maker:
    """``fit`` with a spec; flows that see the spec fit logistic models of all their training sets in shared passes."""

    spec: Spec

    def __call__(self, df: DataFrame) -> Fitted:
        return fit(df, self.spec)


def calibration_parts(df: DataFrame, spec: Spec, folds: int = 3) -> DataFrame:
    """(clip_id, label, view, _part): parts deal each class out by the hash rank of its clips, so every part holds both
    classes."""
    hashed = df.select("clip_id", "label").distinct().withColumn("_h", F.xxhash64(F.lit(spec.seed), "clip_id"))
    parts = ranked(hashed, ["label"], ["_h", "clip_id"], "_rn").select("clip_id", F.pmod(F.col("_rn"), F.lit(folds)).alias("_part"))
    wanted = dict.fromkeys(["clip_id", "label", spec.view])
    return df.select(*wanted).join(parts, "clip_id")


def _sigmoid(df: DataFrame, spec: Spec, folds: int = 3) -> tuple[float, float]:
    """Platt sigmoid on margins of rows left out of the fit."""
    rows = spread(calibration_parts(df, spec, folds)).persist()

    def left_out(k: int) -> DataFrame:
        fitted = fit(rows.where(F.col("_part") != k).drop("_part"), spec, calibrate=False)
        return fitted.margin(rows.where(F.col("_part") == k)).select("label", "margin")

    try:
        outs = parallel([lambda k=k: left_out(k) for k in range(folds)])
        margins = checks.union(outs).withColumn("_x", array_to_vector(F.array("margin"))).persist()
        line = LogisticRegression(featuresCol="_x", labelCol="label", maxIter=100).fit(margins)
        margins.unpersist()
    finally:
        rows.unpersist()
    return float(line.coefficients[0]), float(line.intercept)


@dataclass
class Blend:
    """Weighted models; the score is the weighted sum."""

    parts: list[tuple[Fitted, float]]

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        out, total = df, F.lit(0.0)
        for i, (model, weight) in enumerate(self.parts):
            out = model.score(out, f"_s{i}")
            total = total + F.lit(weight) * F.col(f"_s{i}")
        return out.withColumn(name, total).drop(*[f"_s{i}" for i in range(len(self.parts))])

    def components(self, df: DataFrame) -> DataFrame:
        out = df
        for model, _ in self.parts:
            out = model.score(out, model.spec.name)
        return out

    def save(self, path: str) -> None:
        for i, (model, _) in enumerate(self.parts):
            model.save(f"{path}/part={i}")
        spark = SparkSession.active()
        weights = [(i, w) for i, (_, w) in enumerate(self.parts)]
        table = spark.createDataFrame(weights, "part int, weight double")
        table.write.mode("overwrite").parquet(f"{path}/weights")

    @staticmethod
    def load(path: str) -> Blend:
        rows = SparkSession.active().read.parquet(f"{path}/weights").collect()  # one per member
        return Blend([(Fitted.load(f"{path}/part={r['part']}"), r["weight"]) for r in sorted(rows)])


def fit_blend(df: DataFrame, specs: list[tuple[Spec, float]]) -> Blend:
    fitted = parallel([lambda s=s: fit(df, s) for s, _ in specs])
    return Blend([(model, weight) for model, (_, weight) in zip(fitted, specs)])


def svm_logistic(view: str = "v", svm_weight: float = 0.75) -> list[tuple[Spec, float]]:
    """Three quarters kernel machine, one quarter logistic; weight 1 gives the machine alone."""
    parts = [(Spec("rbf_svm", "svm", view), svm_weight)]
    if svm_weight < 1:
        parts.append((Spec("logistic", "logistic", view, 0.1), 1 - svm_weight))
    return parts


def two_forests(spectral: tuple[int, ...], view: str = "v", trees: int = 300, depth: int = 12):
    """Equal blend of a forest on all columns and one on the spectral columns."""
    return [
        (Spec("forest_full", "forest", view, trees=trees, depth=depth), 0.5),
        (Spec("forest_spectral", "forest", view, trees=trees, depth=depth, columns=spectral), 0.5),
    ]


def parallel(tasks: list, workers: int = 4) -> list:
    """Submit independent Spark jobs from a few driver threads, as CrossValidator does."""
    wrap = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(workers) as pool:
        return [f.result() for f in [pool.submit(wrap(t)) for t in tasks]]


def out_of_fold(
    df: DataFrame, folds: DataFrame, n_folds: int, makers: dict, on: tuple[str, ...] = ("grp",)
) -> DataFrame:
    """Long out-of-fold scores (clip_id, label, grp, fold, model, score).

    ``folds`` maps ``on`` to a fold; ``makers`` maps a model name to a function from training rows
    to something with ``score``.  Rows with their folds are persisted, as every fit reads them.
    """
    placed = df.join(folds.select(*on, "fold"), list(on)).persist()
    placed.count()

    def one(fold: int, name: str):
        def run() -> DataFrame:
            model = makers[name](placed.where(F.col("fold") != fold).drop("fold"))
            scored = model.score(placed.where(F.col("fold") == fold))
            return scored.select("clip_id", "label", "grp", "fold", F.lit(name).alias("model"), "score")

        return run

    return checks.union(parallel([one(f, n) for f in range(n_folds) for n in makers]))


def choose_and_refit(df: DataFrame, oof: DataFrame, makers: dict, path: str | None = None):
    """Model with the lowest out-of-fold minDCF, refitted on every row (and saved)."""
    costs = M.min_dcf(oof, ["model"]).withColumn("partition", F.lit(0))
    best = select_model(costs, list(makers)).where("chosen").first()["model"]
    model = makers[best](df)
    if path is not None:
        model.save(path)
    return best, model


# -- importance and path explanations ----------------------------------------------------------


def importance(blend: Blend, names: tuple[str, ...]) -> DataFrame:
    """Weighted feature importance over the members, one row per feature."""
    total = np.zeros(len(names))
    for model, weight in blend.parts:
        at = list(model.spec.columns) or range(len(names))
        for part in model.forests:
            total[list(at)] += weight * part.getNumTrees / model.spec.trees * part.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, total)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def shared_path(spark: SparkSession) -> str:
    """A new folder in the checkpoint directory that the cluster names."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base}/{uuid.uuid4().hex}"


def _table(model: RandomForestClassificationModel | Kept, path: str | None = None) -> DataFrame:
    """The nodes of a forest as a table, read from where the model is saved."""
    if not isinstance(model, Kept):
        path = path or shared_path(SparkSession.active())
        model.write().overwrite().save(path)
    table = SparkSession.active().read.parquet(f"{model.path if isinstance(model, Kept) else path}/data")
    total = F.aggregate("nodeData.impurityStats", F.lit(0.0), lambda s, v: s + v)
    return table.select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("id"),
        (F.coalesce(F.get("nodeData.impurityStats", 1), F.lit(0.0)) / total).alias("p"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", 0).alias("cut"),
    )


def _nodes(model: RandomForestClassificationModel | Kept, path: str | None = None) -> DataFrame:
    """(tree, id, p, left, right, feature) of a forest."""
    return _table(model, path).drop("cut")


def _packed(parts: list[pa.Table], depth: int) -> Trees:
    """The nodes of a forest's parts as flat arrays."""
    roots, children, features, values, size = [], [], [], [], 0
    for part in parts:
        part = part.sort_by([("tree", "ascending"), ("id", "ascending")])
        tree, left, right = (part[c].to_numpy() for c in ("tree", "left", "right"))
        root = np.flatnonzero(np.diff(tree, prepend=-1))
        first = root[np.cumsum(np.isin(np.arange(len(tree)), root)) - 1]  # of the node's tree; ids count from there
        inner, own = left >= 0, np.arange(len(tree))
        child = np.stack([np.where(inner, first + side, own) for side in (left, right)], axis=1) + size
        roots.append(root + size)
        children.append(child.ravel().astype(np.int32))
        features.append(np.where(inner, part["feature"].to_numpy(), 0).astype(np.int32))
        values.append(np.where(inner, part["cut"].fill_null(0.0).to_numpy(), part["p"].to_numpy()))
        size += len(tree)
    return Trees(*map(np.concatenate, (roots, children, features, values)), depth)


def _leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, feature, gain): what each feature adds to the probability on the way to a leaf.

    Leaves are numbered as ``leafCol`` numbers them, in the order of node ids.  A group is one tree, whose nodes
    are bounded by 2^(depth+1).
    """

    def climb(tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.sort_values("id", ignore_index=True)
        p, feature = tree["p"].to_numpy(), tree["feature"].to_numpy()
        left, right = tree["left"].to_numpy(), tree["right"].to_numpy()
        inner = np.flatnonzero(left >= 0)
        parent = np.zeros(len(tree), dtype=int)
        parent[left[inner]] = parent[right[inner]] = inner
        at = np.flatnonzero(left < 0)
        leaf = np.arange(len(at))
        steps = [pd.DataFrame({"leaf": leaf[:0], "feature": leaf[:0], "gain": p[:0]})]
        while (live := at > 0).any():
            at, leaf = at[live], leaf[live]
            up = parent[at]
            steps.append(pd.DataFrame({"leaf": leaf, "feature": feature[up], "gain": p[at] - p[up]}))
            at = up
        out = pd.concat(steps).groupby(["leaf", "feature"], as_index=False)["gain"].sum()
        return out.assign(tree=tree["tree"].iloc[0])[["tree", "leaf", "feature", "gain"]]

    return nodes.groupBy("tree").applyInPandas(climb, "tree int, leaf int, feature int, gain double")


def path_contributions(df: DataFrame, blend: Blend, width: int) -> DataFrame:
    """Add ``baseline`` and ``contributions``: the root probability and, per feature, the summed
    change of probability along the paths.  They add up to the blend's score.

    The forests name the leaf that a clip reaches in each tree; leaves meet the table of their paths, and sums per
    (clip, feature) form in the map tasks.  Nodes pass neither through the driver nor through a broadcast of this
    function's own.  ``clip_id`` names a row; ``df`` is read twice.
    """
    paths, roots, reached = [], [], []
    for m, (model, weight) in enumerate(blend.parts):
        share, columns, before = F.lit(weight / model.spec.trees), F.array(*map(F.lit, model.spec.columns or range(width))), 0
        for part in model.forests:
            nodes = _nodes(part).withColumn("tree", F.col("tree") + before)
            path = _leaf_paths(nodes).select(
                F.lit(m).alias("_member"), "tree", "leaf", F.get(columns, F.col("feature")).alias("_column"), (share * F.col("gain")).alias("_gain")
            )
            paths.append(path)
            roots.append(nodes.where("id = 0").select((share * F.col("p")).alias("p")))
            before += part.getNumTrees
        member, leaves = F.lit(m).alias("_member"), model._walked(df, "array<int>", Trees.leaves)
        reached.append(F.transform(leaves, lambda x, i: F.struct(member, i.alias("tree"), x.alias("leaf"))))  # noqa: B023
    at = df.select("clip_id", F.inline(F.concat(*reached)))
    gains = at.join(checks.union(paths), ["_member", "tree", "leaf"]).groupBy("clip_id", "_column").agg(F.sum("_gain").alias("_gain"))
    of_clip = gains.groupBy("clip_id").agg(F.map_from_entries(F.collect_list(F.struct("_column", "_gain"))).alias("_gains"))
    every = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.col("_gains")[i], F.lit(0.0)))
    none = F.array_repeat(F.lit(0.0), width)
    out = df.withColumn("baseline", checks.union(roots).agg(F.sum("p")).scalar()).join(of_clip, "clip_id", "left")
    return out.withColumn("contributions", F.when(F.col("_gains").isNull(), none).otherwise(every)).drop("_gains")


# -- condition clusters ------------------------------------------------------------------------


def condition_clusters(
    df: DataFrame, vector: str, clusters: int = 3, min_size: int = MIN_CLUSTER, restarts: int = 20, seed: int = 42,
    name: str = "clip_id",
) -> tuple[DataFrame, DataFrame, int]:
    """K-means on the standardized condition vector, the restart with the lowest cost; all restarts share the passes.

    ``name`` names a row.  Returns (scaler row, centroids, number of clusters).
    """
    spark = df.sparkSession
    keyed = df.select(vector, name, F.array(F.lit(0)).alias("_keys"))
    fit = keyed_kmeans(keyed, vector, "_keys", name, clusters, restarts, min_size=min_size, seed=seed).first()
    if fit is None:
        raise ValueError("no rows to cluster")
    stats = spark.createDataFrame([(fit.mean, fit.scale)], "mean array<double>, scale array<double>")
    centers = spark.createDataFrame(list(enumerate(fit.centers)), "cluster int, center array<double>")
    return stats, centers, len(fit.centers)


def fit_condition_router(
    df: DataFrame, vector: str, a: str, b: str, clusters: int = 3, min_size: int = MIN_CLUSTER, restarts: int = 20
) -> Router:
    """Condition clusters plus a blend weight for each."""
    stats, centers, _ = condition_clusters(df, vector, clusters, min_size, restarts)
    placed = nearest(standardized(df, stats, vector, "_z"), centers, "_z").drop("_z")
    return fit_router(placed, "cluster", vector, a, b, centers, stats, min_size)
