"""Shared helpers: table access, lineage cuts, code shipping."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipscore.session import ship

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null text as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    The folder is that of :func:`shared_folder`.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from it.

    For loops: a checkpoint hands the constraints of its plan on, which grow from round to round.
    """
    place = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``.

    Only a local session without one (a test) gets its own; elsewhere a machine's own folder would lose data.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return shared or tempfile.mkdtemp(prefix="spark-")


HOT_KEYS = 100_000


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` with the other columns of ``facts``, one row a ``key`` (nulls are equal), null where it has none.

    ``weight`` of a fact is at least its share of the rows.  Keys with more than one in ``hot_keys`` of the
    whole weight are fewer than ``hot_keys``: their facts are broadcast and meet the rows where these lie.
    Rows of other keys meet their facts in a shuffle, in which no key is large and hot rows are spread.
    ``facts`` is read three times and should be a written table.
    """
    values = [c for c in facts.columns if c not in (key, weight)]
    total = facts.agg(F.sum(F.col(weight).cast("double"))).scalar()
    heavy = F.col(weight) * float(hot_keys) > total
    packed = F.struct(*values)
    hot = facts.where(heavy).select(F.col(key).alias("_hot_key"), packed.alias("_hot"))
    cold = facts.where(~heavy).select(F.col(key).alias("_cold_key"), F.lit(0).cast("bigint").alias("_cold_place"), packed.alias("_cold"))
    met = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot_key")), "left")
    spread = met.withColumn("_place", F.when(F.col("_hot").isNull(), 0).otherwise(F.monotonically_increasing_id() + 1))
    both = spread.join(cold, F.col(key).eqNullSafe(F.col("_cold_key")) & (F.col("_place") == F.col("_cold_place")), "left")
    return both.select(*[F.col(c) for c in rows.columns], *[F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also when a lambda inside uses it."""
    return F.transform(F.array(value), body)[0]


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with the package sent along, so that workers find it wherever the driver started."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
