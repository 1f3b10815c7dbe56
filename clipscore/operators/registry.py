"""Fits keyed by (model, fold): each is made once and kept with its scores, which every report reads from one table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipscore.operators import splits
from clipscore.operators.logistic import keyed_logistic
from clipscore.operators.models import Blend, Fitted, Maker, Spec, parallel
from clipscore.sources import checks

ALL = -1  # the "fold" of fits on every row, whose scores are those of unseen rows


@dataclass(frozen=True)
class Registry:
    """A folder of scores (one part a (fold, model)) and of the models fitted on every row."""

    path: str

    def place(self, model: str, fold: int) -> str:
        return f"{self.path}/scores/fold={fold}/model={model}"

    def scores(self, spark: SparkSession) -> DataFrame:
        """(clip_id, label, grp, score, fold, model) of all fits."""
        made = spark.read.option("basePath", f"{self.path}/scores").parquet(f"{self.path}/scores")
        return made.withColumns({"fold": F.col("fold").cast("int"), "model": F.col("model").cast("string")})

    def out_of_fold(self, spark: SparkSession) -> DataFrame:
        return self.scores(spark).where(F.col("fold") != ALL)

    def unseen(self, spark: SparkSession) -> DataFrame:
        return self.scores(spark).where(F.col("fold") == ALL)

    def model(self, name: str, kind: type[Fitted] | type[Blend] = Fitted) -> Fitted | Blend:
        return kind.load(f"{self.path}/models/{name}")


def committed(spark: SparkSession, place: str) -> bool:
    """Whether a write to ``place`` has been committed."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def shareable(makers: Mapping[str, Callable]) -> dict[str, Spec]:
    """The specs of those makers whose fits can share passes."""
    return {name: m.spec for name, m in makers.items() if isinstance(m, Maker) and m.spec.family == "logistic"}


def fit_together(rows: DataFrame, sets: Mapping[int, tuple[str, int, Mapping[str, Spec]]]) -> None:
    """Fit and keep the logistic models of many training sets, all in the same passes over ``rows``.

    ``sets`` maps the code of a set to the folder of its registry, the fold that it leaves out and its specs by model
    name.  ``rows`` hold the codes of the sets that a row trains (``trains``) and of those that score it (``held``).
    What an earlier run has committed is not fitted again.
    """
    spark = rows.sparkSession
    todo: dict[str, dict[int, dict[str, Spec]]] = {}
    for code, (path, fold, specs) in sets.items():
        missing = {m: s for m, s in specs.items() if not committed(spark, Registry(path).place(m, fold))}
        if missing:
            todo.setdefault(path, {})[code] = missing
    if not todo:
        return
    lines = keyed_logistic(rows, "trains", {code: specs for of in todo.values() for code, specs in of.items()})
    for path, of in todo.items():
        fold = F.create_map(*[F.lit(v) for code in of for v in (code, sets[code][1])])
        scored = lines.scores(rows, "held", list(of)).withColumn("fold", fold[F.col("key")]).drop("key")
        kept = scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        kept.partitionBy("fold", "model").parquet(f"{path}/scores")
        for code, specs in of.items():
            for model in specs:
                if sets[code][1] == ALL:
                    lines.models[code, model].save(f"{path}/models/{model}")
                mark(spark, Registry(path).place(model, sets[code][1]))


def mark(spark: SparkSession, place: str) -> None:
    """Say that what is in ``place`` has been committed."""
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True).close()


def build(
    df: DataFrame,
    folds: DataFrame,
    n_folds: int,
    makers: Mapping[str, Callable],
    path: str,
    unseen: DataFrame | None = None,
    on: tuple[str, ...] = ("grp",),
    workers: int = 4,
) -> Registry:
    """Fit every maker without each fold and score that fold; with ``unseen`` rows also fit it on all rows.

    ``folds`` maps ``on`` to a fold.  A (model, fold) that an earlier run has committed is not fitted again.
    Logistic models fit together, in shared passes over the rows.  Every clip must then have exactly one finite score per model.
    """
    spark = df.sparkSession
    registry = Registry(path)
    wanted = list(range(n_folds)) + ([] if unseen is None else [ALL])
    specs = shareable(makers)
    if specs:
        sided(df.join(folds.select(*on, "fold"), list(on)), path, wanted, specs, unseen)
    rest = [name for name in makers if name not in specs]
    placed = df.join(folds.select(*on, "fold"), list(on))
    if rest:
        placed = placed.persist()

    def keep(scored: DataFrame, name: str, fold: int) -> None:
        scored.select("clip_id", "label", "grp", "score").write.mode("overwrite").parquet(registry.place(name, fold))

    def one(name: str, fold: int):
        def run() -> None:
            if committed(spark, registry.place(name, fold)):
                return
            if fold == ALL:
                model = makers[name](placed.drop("fold"))
                model.save(f"{path}/models/{name}")
                keep(model.score(unseen), name, fold)
            else:
                model = makers[name](placed.where(F.col("fold") != fold).drop("fold"))
                keep(model.score(placed.where(F.col("fold") == fold)), name, fold)

        return run

    try:
        parallel([one(name, fold) for fold in wanted for name in rest], workers)
        oof = registry.out_of_fold(spark).where(F.col("model").isin(list(makers)))
        models = spark.createDataFrame([(name,) for name in makers], "model string")
        gaps = splits.completeness(oof, ["model"], placed.select("clip_id"), models)
        checks.fail_if_any(gaps, "out-of-fold scores")
    finally:
        placed.unpersist()
    return registry


def sided(placed: DataFrame, path: str, wanted: list[int], specs: Mapping[str, Spec], unseen: DataFrame | None) -> None:
    """The shared fits of one registry: a row trains all sets but the one that leaves its fold out, and is scored by that."""
    sets = F.array(*map(F.lit, wanted))
    fold = F.col("fold").cast("int")
    rows = placed.withColumns({"trains": F.filter(sets, lambda k: k != fold), "held": F.array(fold)})
    if unseen is not None:
        none = F.array().cast("array<int>")
        rows = rows.unionByName(unseen.withColumns({"trains": none, "held": F.array(F.lit(ALL))}), allowMissingColumns=True)
    views = {s.view for s in specs.values()}
    rows = rows.select("clip_id", "label", "grp", *sorted(views), "trains", "held").persist()
    try:
        fit_together(rows, {fold: (path, fold, specs) for fold in wanted})
    finally:
        rows.unpersist()


def with_blends(scores: DataFrame, blends: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``scores`` and the rows of fixed blends of its models, for any fold; a blend costs no fit.

    All blends are sums of one pass over the scores of a clip.
    """
    if not blends:
        return scores
    keys = ["clip_id", "label", "grp", "fold"]

    def part(weights: Mapping[str, float]):
        weight = F.lit(0.0)
        for model, w in weights.items():
            weight = F.when(F.col("model") == model, F.lit(float(w))).otherwise(weight)
        return F.sum(weight * F.col("score"))

    sums = scores.groupBy(*keys).agg(*[part(w).alias(f"_b{i}") for i, w in enumerate(blends.values())])
    rows = [F.struct(F.lit(name).alias("model"), F.col(f"_b{i}").alias("score")) for i, name in enumerate(blends)]
    return scores.select(*keys, "model", "score").unionByName(sums.select(*keys, F.inline(F.array(*rows))))
