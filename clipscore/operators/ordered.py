"""Exact ordered computations (running sums, ranks, neighbours) that survive hot keys.

``Window.partitionBy(key).orderBy(x)`` puts every row of a key into one task.  Here a key is cut into
contiguous ranges of the order:

1. a range number per row, monotone in the order;
2. totals per (key, range), whose running sum has one row a range;
3. a window inside each (key, range), shifted by the offset of the range.

Where the caller can name the range (``place``: scores in [0, 1] have natural ones) that is the
whole plan, without a look at the data.  Other orders measure the largest key first (one number
reaches the driver): only if it is beyond ``HOT_ROWS`` are there keys to cut.  Each hot key
is then cut at splitters of its own, on the whole order, found in the same job from a hash-chosen
sample; their number grows with the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOT_ROWS = 2_000_000
OVERSAMPLE = 8
RANGES = 4096  # of scores


def largest_key(df: DataFrame, keys: list[str]) -> int:
    """Row count of the biggest key; the single number is all that leaves the cluster."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def score_range(score: Column, ranges: int = RANGES) -> Column:
    """Equal ranges of [0, 1]; values outside go to the first and last, NaN (the largest) to the last."""
    inside = F.floor(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)) * ranges)
    return F.when(F.isnan(score), ranges).otherwise(inside).cast("int")


def _at_or_below(cuts: Column, value: Column) -> Column:
    """How many of the sorted ``cuts`` are at or below ``value``, by binary search."""
    start = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        open_ = state["low"] < state["high"]
        ahead = open_ & (F.get(cuts, middle) <= value)
        return F.struct(
            F.when(ahead, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(open_ & ~ahead, middle).otherwise(state["high"]).alias("high"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), start, halve, lambda s: s["low"])


def _split_hot(rows: DataFrame, keys: list[str], order: list[str], hot_rows: int) -> DataFrame:
    """Rows with their range ``_b``: 0 for small keys, about four ranges for each ``hot_rows`` rows of the others."""
    whole = F.struct(*order)
    single = [] if keys else [F.lit(0).alias("_only")]
    by = keys or ["_only"]
    named = rows.select("*", *single)
    counts = named.groupBy(*by).count().where(F.col("count") > hot_rows).withColumnRenamed("count", "_key_rows")
    ranges = F.ceil(F.lit(4.0) * F.col("_key_rows") / hot_rows)
    draw = F.pmod(F.xxhash64(F.lit("splitters"), *order), F.lit(1 << 30)) / float(1 << 30)
    sample = named.join(counts, by).where(draw * F.col("_key_rows") < OVERSAMPLE * ranges)
    every = lambda x, i: i % OVERSAMPLE == OVERSAMPLE - 1
    cuts = sample.groupBy(*by).agg(F.filter(F.array_sort(F.collect_list(whole)), every).alias("_cuts"))
    split = named.join(cuts, by, "left")
    place = F.when(F.col("_cuts").isNull(), 0).otherwise(_at_or_below(F.col("_cuts"), whole))
    return split.withColumn("_b", place).drop("_cuts", *([] if keys else by))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    prev: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
    place: Column | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Add ``<name>_before`` and ``<name>_total`` for every entry of ``sums`` and ``prev_<c>``.

    ``_before`` is the exclusive running sum inside ``keys`` by ``order``; ``_total`` the key's
    sum; ``prev_<c>`` the value of ``c`` on the preceding row (null on the first).  ``largest`` is a bound
    on the rows of a key where the caller knows one.
    """
    prev = prev or []
    rows = df.select("*", *[e.alias(f"_v_{n}") for n, e in sums.items()])
    if place is None and (largest_key(df, keys) if largest is None else largest) <= hot_rows:
        whole = Window.partitionBy(*keys)
        along = whole.orderBy(*order)
        upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select(
            *df.columns,
            *[
                (F.sum(f"_v_{n}").over(upto) - F.col(f"_v_{n}")).alias(f"{n}_before") for n in sums
            ],
            *[F.sum(f"_v_{n}").over(whole).alias(f"{n}_total") for n in sums],
            *[F.lag(c).over(along).alias(f"prev_{c}") for c in prev],
        )

    rows = _split_hot(rows, keys, order, hot_rows) if place is None else rows.withColumn("_b", place)
    parts = rows.groupBy(*keys, "_b").agg(
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums],
        *([F.max_by(F.struct(*prev), F.struct(*order)).alias("_last")] if prev else []),
    )
    ranges = Window.partitionBy(*keys).orderBy("_b")
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *keys,
        "_b",
        *[F.sum(f"_s_{n}").over(before).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(Window.partitionBy(*keys)).alias(f"_t_{n}") for n in sums],
        *([F.lag("_last").over(ranges).alias("_carry")] if prev else []),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The explicit repartition keeps a hot key spread by range even where Spark could reuse a
    # partitioning on the key alone.
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in (*keys, "_b")]
    joined = rows.alias("r").join(offsets.alias("o"), reduce(lambda a, b: a & b, same))
    carried = [c for c in offsets.columns if c not in (*keys, "_b")]
    placed = joined.select("r.*", *[f"o.{c}" for c in carried]).repartition(*keys, "_b")
    zero = F.lit(0)
    return placed.select(
        *df.columns,
        *[
            (
                F.coalesce(F.col(f"_o_{n}"), zero) + F.sum(f"_v_{n}").over(upto) - F.col(f"_v_{n}")
            ).alias(f"{n}_before")
            for n in sums
        ],
        *[F.col(f"_t_{n}").alias(f"{n}_total") for n in sums],
        *[
            F.when(F.row_number().over(inside) > 1, F.lag(c).over(inside))
            .otherwise(F.col(f"_carry.{c}"))
            .alias(f"prev_{c}")
            for c in prev
        ],
    )


def ranked(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "rn",
    total: str | None = None,
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Exact ``row_number`` inside ``keys`` by the unique ordering ``order``."""
    out = running(df, keys, order, {"_n": F.lit(1).cast("long")}, hot_rows=hot_rows, largest=largest)
    cols = [*df.columns, (F.col("_n_before") + 1).alias(name)]
    if total:
        cols.append(F.col("_n_total").alias(total))
    return out.select(*cols)


def bottom_k(
    df: DataFrame, keys: list[str], order: list[str], k: int, name: str = "rn", salts: int = 64
) -> DataFrame:
    """First ``k`` rows of each key.  A salted first pass cuts a hot key to ``salts * k`` rows
    (Spark's window group limit also trims each map task) before one task ranks the rest."""
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
        .withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= k)
        .drop("_salt", "_r")
        .withColumn(name, F.row_number().over(last))
        .where(F.col(name) <= k)
    )


def chunked(df: DataFrame, index: str, halo: int, size: int = 65_536) -> DataFrame:
    """Cut ordered rows into chunks of ``size`` consecutive indexes, copying ``halo`` rows over
    each border.  Windows over (key, ``_chunk``) then see every neighbour within ``halo`` rows;
    drop the copies afterwards with ``own_rows``."""
    home = F.floor(F.col(index) / size)
    offset = F.pmod(F.col(index), F.lit(size))
    targets = F.array_compact(
        F.array(
            home,
            F.when((offset < halo) & (home > 0), home - 1),
            F.when(offset >= size - halo, home + 1),
        )
    )
    return df.withColumn("_home", home).withColumn("_chunk", F.explode(targets))


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")
