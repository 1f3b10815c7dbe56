"""Reproducible selection by hash rank: bottom-k, round robin, group quotas, even spacing."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipscore.operators.ordered import HOT_ROWS, bottom_k, ranked


def name_hash(name: Column) -> Column:
    """Order-free priority of a name; ties are broken by the name itself."""
    return F.md5(name.cast("string"))


def seeded_hash(seed: Column | int, name: Column) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), name.cast("string")))


def hash_bottom_k(df: DataFrame, group: str, name: str, k: int) -> DataFrame:
    """The ``k`` rows of each group with the lowest name hash, with their rank ``rn``."""
    return bottom_k(df.withColumn("h", name_hash(F.col(name))), [group], ["h", name], k)


def round_robin(df: DataFrame, group: str, name: str, k: int, target: int) -> DataFrame:
    """Allocate ``target`` rows over the sorted groups, one per group and round, until groups run
    out; candidates are the hash bottom-``k``.

    How many each group gives follows from the group sizes alone: all of round r is taken while
    the rounds up to r fit, and the last round is cut by group name.  Only (round, group) counts
    are ordered, never the rows; there are at most ``k`` rounds.
    """
    rows = hash_bottom_k(df, group, name, k)
    sizes = df.groupBy(group).agg(F.least(F.count("*"), F.lit(k)).alias("size"))
    # Rounds 1..size each take one row: count groups per round through the size histogram.
    per_size = sizes.groupBy("size").agg(F.count("*").alias("groups"))
    above = Window.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = per_size.select(
        "size",
        F.sum("groups").over(above).alias("alive"),
        F.coalesce(F.lag("size").over(Window.orderBy("size")), F.lit(0)).alias("below"),
    )
    filled = steps.select(
        "size",
        "alive",
        "below",
        (
            F.sum((F.col("size") - F.col("below")) * F.col("alive")).over(
                Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
            )
            - (F.col("size") - F.col("below")) * F.col("alive")
        ).alias("before"),
    )
    # Full rounds that fit, and what is left for the next one.
    fit = F.least(
        F.col("size"), F.col("below") + F.floor((F.lit(target) - F.col("before")) / F.col("alive"))
    )
    spare = F.lit(target) - F.col("before") - (fit - F.col("below")) * F.col("alive")
    last = (
        filled.where(F.col("before") <= target)
        .agg(F.max(F.struct("size", fit.alias("full"), spare.alias("spare"))).alias("c"))
        .select("c.full", "c.spare")
    )
    cut = last.select(F.struct("full", "spare")).scalar()
    ordered = rows.withColumn("_cut", cut)
    whole = ordered.where(F.col("rn") <= F.col("_cut.full"))
    partial = ranked(
        ordered.where(F.col("rn") == F.col("_cut.full") + 1).drop("_cut"), [], [group], "_place"
    )
    partial = partial.withColumn("_cut", cut).where(F.col("_place") <= F.col("_cut.spare"))
    return whole.drop("_cut").unionByName(partial.drop("_cut", "_place"))


def balanced_sample(
    df: DataFrame, label: str, group: str, name: str, cap: int, seed: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Up to ``cap`` rows per class with every group represented.

    Each group may give ``cap div G`` rows, plus one for the first ``cap mod G`` groups by name;
    what small groups leave unused goes to the leftover rows with the lowest hash.
    """
    rows = df.withColumn("_h", seeded_hash(seed, F.col(name)))
    sizes = df.groupBy(label, group).agg(F.count("*").alias("_size"))
    placed = ranked(sizes, [label], [group], "_g", "_groups", hot_rows)
    quota = F.floor(F.lit(cap) / F.col("_groups")) + (
        F.col("_g") <= F.pmod(F.lit(cap), F.col("_groups"))
    ).cast("long")
    quotas = placed.withColumn("_quota", F.least(F.col("_size"), quota))
    short = quotas.groupBy(label).agg(
        (F.lit(cap) - F.sum("_quota")).alias("_short"), F.sum("_size").alias("_n")
    )
    in_group = ranked(rows, [label, group], ["_h", name], "_k", hot_rows=hot_rows)
    judged = in_group.join(quotas.select(label, group, "_quota"), [label, group])
    judged = judged.join(F.broadcast(short), label)  # one row per class
    everything = F.col("_n") <= cap
    picked = judged.where(everything | (F.col("_k") <= F.col("_quota")))
    spare = judged.where(~everything & (F.col("_k") > F.col("_quota")) & (F.col("_short") > 0))
    filled = ranked(spare, [label], ["_h", name], "_l", hot_rows=hot_rows).where("_l <= _short")
    return picked.select(*df.columns).unionByName(filled.select(*df.columns))


def spaced_positions(n: int, k: int) -> list[int]:
    """``k`` distinct zero-based positions spread evenly over ``n`` rows, ends included."""
    if k <= 1:
        return [0] if n and k else []
    return sorted({int(Fraction(i * (n - 1), k - 1)) for i in range(k)})


def evenly_spaced(
    df: DataFrame, keys: list[str], order: list[str], k: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``k`` evenly spaced rows of each key (all rows where a key has fewer).

    Row i of n is chosen when some j in 0..k-1 gives floor(j(n-1)/(k-1)) = i; the smallest such j
    is ceil(i(k-1)/(n-1)), so no join with the position list is needed.
    """
    rows = ranked(df, keys, order, "_rn", "_n", hot_rows)
    i, n = F.col("_rn") - 1, F.col("_n")
    if k == 1:
        return rows.where(i == 0).drop("_rn", "_n")
    j = F.expr(f"((_rn - 1) * {k - 1} + _n - 2) div (_n - 1)")
    hit = (n <= k) | (F.expr("_n > 1") & (F.floor(j * (n - 1) / F.lit(k - 1)) == i))
    return rows.where(hit).drop("_rn", "_n")


def top_contributions(values: Column, names: Column, k: int = 8, floor: float = 1e-8) -> Column:
    """The ``k`` largest absolute values of a contribution vector as structs, sorted inside the row
    (no shuffle); ties keep feature order."""
    entries = F.transform(
        F.arrays_zip(values.alias("v"), names.alias("n")),
        lambda e, i: F.struct(
            (-F.abs(e["v"])).alias("key"), i.alias("pos"), e["n"].alias("feature"),
            e["v"].alias("contribution"),
        ),
    )
    kept = F.filter(entries, lambda e: -e["key"] > floor)
    return F.slice(F.array_sort(kept), 1, k)
