"""Group-disjoint splits and folds, ranked by seeded hash instead of a shuffled array."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipscore.operators.ordered import HOT_ROWS, ranked
from clipscore.operators.sampling import seeded_hash

SPLIT_TRIES = 100


def _class_counts(df: DataFrame, label: str) -> dict[int, int]:
    """Rows per class (two numbers)."""
    row = df.agg(
        F.count_if(F.col(label) == 0).alias("r"), F.count_if(F.col(label) == 1).alias("s")
    ).first()
    return {0: row["r"], 1: row["s"]}


def clip_split(
    df: DataFrame, label: str, name: str, test_size: float, seed: int, hot_rows: int = HOT_ROWS
) -> DataFrame | None:
    """Stratified clip split: adds ``side``; None when no useful two-class holdout exists."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie strictly between 0 and 1")
    counts = _class_counts(df, label)
    n = sum(counts.values())
    n_test = max(2, math.ceil(n * test_size))
    if n < 10 or min(counts.values()) < 3 or n - n_test < 2:
        return None
    # Largest remainder: the minority class takes the rounding that the majority leaves.
    minority = min(counts, key=lambda c: (counts[c], c))
    few = min(max(1, round(n_test * counts[minority] / n)), counts[minority] - 1)
    many = n_test - few
    if many < 1 or many >= counts[1 - minority]:
        return None
    hashed = df.withColumn("_h", seeded_hash(seed, F.col(name)))
    rows = ranked(hashed, [label], ["_h", name], "_rn", hot_rows=hot_rows)
    quota = F.when(F.col(label) == minority, few).otherwise(many)
    return rows.withColumn(
        "side", F.when(F.col("_rn") <= quota, "test").otherwise("train")
    ).drop("_h", "_rn")


CLIP_SPLIT_SQL = """tot AS (SELECT count(*) AS n, sum(label) AS ns, greatest(2, CAST(ceil(count(*)*2e-1) AS BIGINT)) AS nt FROM scored),
quota AS (SELECT greatest(1, CAST(round_even(nt*ns/(n*1e0), 0) AS BIGINT)) AS few, nt FROM tot),
parted AS (SELECT s.clip_id, s.label, s.grp, CASE WHEN row_number() OVER (PARTITION BY s.label
 ORDER BY md5(concat('42:', CAST(s.clip_id AS VARCHAR))), s.clip_id)
 <= CASE WHEN s.label = 1 THEN q.few ELSE q.nt - q.few END THEN 'test' ELSE 'train' END AS side FROM scored s, quota q)"""


def group_table(df: DataFrame, label: str, group: str) -> DataFrame:
    """Rows of each class per group."""
    return df.groupBy(group).agg(
        F.count_if(F.col(label) == 0).alias("real"), F.count_if(F.col(label) == 1).alias("spoof")
    )


def seeded_group_ranks(
    groups: DataFrame, group: str, seeds: list[int], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every group ranked by hash under each seed (``seed``, ``rn``); seeds are a short list."""
    drawn = groups.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    drawn = drawn.withColumn("_h", seeded_hash(F.col("seed"), F.col(group)))
    return ranked(drawn, ["seed"], ["_h", group], "rn", hot_rows=hot_rows).drop("_h")


def group_split_scores(
    df: DataFrame, label: str, group: str, test_size: float, seed: int, tries: int = SPLIT_TRIES
) -> tuple[DataFrame, int, DataFrame] | None:
    """Candidate group holdouts: (group table, groups held out, one score per usable seed), or None.

    A seed holds out the groups of the least hashes.  Class totals per (seed, first hash digits) are formed
    in the map tasks, so what is shuffled does not grow with the groups; only groups whose digits
    are those of a seed's last held group (one in 256 a seed) are ranked.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie strictly between 0 and 1")
    groups = group_table(df, label, group)
    facts = groups.agg(
        F.count("*").alias("g"), F.sum("real").alias("r"), F.sum("spoof").alias("s")
    ).first()
    if (facts["r"] or 0) + (facts["s"] or 0) < 10 or min(facts["r"], facts["s"]) < 3:
        return None
    n_test = max(2, math.ceil(facts["g"] * test_size))
    if facts["g"] < 4 or n_test > facts["g"] - 2:
        return None
    seeds = F.sequence(F.lit(seed), F.lit(seed + tries - 1))
    drawn = groups.withColumn("seed", F.explode(seeds)).withColumn("_h", seeded_hash(F.col("seed"), F.col(group)))
    drawn = drawn.withColumn("_bin", F.substring("_h", 1, 2))
    cells = drawn.groupBy("seed", "_bin").agg(F.count("*").alias("n"), F.sum("real").alias("r"), F.sum("spoof").alias("s"))
    before = Window.partitionBy("seed").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "r", "s")]
    edge = cells.select("seed", "_bin", "n", *sums).where(
        (F.col("n_before") < n_test) & (F.col("n_before") + F.col("n") >= n_test)
    ).drop("n")
    inside = ranked(drawn.join(F.broadcast(edge), ["seed", "_bin"]), ["seed"], ["_h", group], "_rn")  # one row a seed
    held = inside.where(F.col("n_before") + F.col("_rn") <= n_test).groupBy("seed")
    scores = (
        held.agg(
            (F.max("r_before") + F.sum("real")).alias("tr"), (F.max("s_before") + F.sum("spoof")).alias("ts")
        )
        .where(
            (F.col("tr") > 0)
            & (F.col("ts") > 0)
            & (F.col("tr") < facts["r"])
            & (F.col("ts") < facts["s"])
        )
        .withColumn(
            "score",
            F.abs(F.col("tr") / facts["r"] - test_size) + F.abs(F.col("ts") / facts["s"] - test_size),
        )
    )
    return groups, n_test, scores


def group_split(
    df: DataFrame,
    label: str,
    group: str,
    test_size: float = 0.2,
    seed: int = 42,
    tries: int = SPLIT_TRIES,
) -> DataFrame | None:
    """Group holdout nearest the requested share of each class; adds ``side``."""
    found = group_split_scores(df, label, group, test_size, seed, tries)
    if found is None:
        return None
    groups, n_test, scores = found
    # Rounded so that equal scores tie whatever the summation order; the first seed wins.
    best = scores.agg(F.min_by("seed", F.struct(F.round("score", 12), "seed"))).first()[0]
    if best is None:
        return None
    test = seeded_group_ranks(groups, group, [best]).where(F.col("rn") <= n_test).select(group)
    flagged = df.join(test.withColumn("_t", F.lit(True)), group, "left")
    return flagged.withColumn(
        "side", F.when(F.col("_t"), "test").otherwise("train")
    ).drop("_t").select(*df.columns, "side")


def split_data(
    df: DataFrame,
    label: str,
    name: str,
    group: str | None = None,
    test_size: float = 0.2,
    seed: int = 42,
) -> DataFrame | None:
    """Grouped split when a group column is given, stratified clip split otherwise."""
    if group is None:
        return clip_split(df, label, name, test_size, seed)
    return group_split(df, label, group, test_size, seed)


def group_holdouts(df: DataFrame, label: str, group: str, share: float, seeds: list[int]) -> DataFrame:
    """Random group holdouts for several seeds: (seed, group, held); seeds whose train or test side
    lacks a class are left out."""
    groups = group_table(df, label, group)
    n_test = math.ceil(groups.count() * share)
    drawn = seeded_group_ranks(groups, group, seeds).withColumn("held", F.col("rn") <= n_test)
    both = drawn.groupBy("seed").agg(
        *[
            F.sum(F.when(F.col("held") == side, F.col(c)).otherwise(0)).alias(f"{c}_{int(side)}")
            for side in (True, False)
            for c in ("real", "spoof")
        ]
    )
    usable = both.where("real_1 > 0 AND spoof_1 > 0 AND real_0 > 0 AND spoof_0 > 0").select("seed")
    return drawn.join(usable, "seed").select("seed", group, "held")


def _fill(folds: int):
    """Greedy packing of equal-size batches: given (size, groups) per key from large to small,
    return where each batch starts, i.e. the load of every fold before it."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("size", ascending=False)
        load, starts = [0] * folds, []
        for size, groups in zip(batch["size"], batch["groups"]):
            starts.append(list(load))
            size, left = int(size), int(groups)
            # How many each fold takes: folds below a common level are raised to it first.
            low, high = min(load), max(load) + size * (left + 1)
            while low < high:
                level = (low + high) // 2
                if sum(max(0, -(-(level - x) // size)) for x in load) >= left:
                    high = level
                else:
                    low = level + 1
            take = [max(0, -(-(low - 1 - x) // size)) for x in load]
            left -= sum(take)
            for fold in range(folds):
                nxt = load[fold] + take[fold] * size
                if left and nxt == low - 1:
                    take[fold] += 1
                    left -= 1
            load = [x + t * size for x, t in zip(load, take)]
        return batch.assign(starts=starts)

    return run


def group_sizes(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Rows per (keys, group) as ``size``; fold building works on this table, never on the rows."""
    return df.groupBy(*dict.fromkeys([*keys, group])).agg(F.count("*").alias("size"))


def greedy_folds(
    sizes: DataFrame,
    keys: list[str],
    group: str,
    folds: int,
    tie: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Largest group first into the emptiest fold (lowest index on ties), per ``keys``.

    The rule looks sequential over groups, but groups of one size are interchangeable: the fold of
    the i-th of them is read off the i-th smallest of (load + j * size, fold).  Only distinct sizes
    are walked in order, at most sqrt(2 * rows) of them per key, and every group then finds its
    fold on its own.  Equal sizes are ordered by ``tie`` (default: the group name).
    Returns one row per (keys, group): ``n`` and ``fold``.
    """
    sizes = sizes if keys else sizes.withColumn("_k", F.lit(0))
    by = keys or ["_k"]
    batches = sizes.groupBy(*by, "size").agg(F.count("*").alias("groups"))
    fields = batches.schema.simpleString()[len("struct<") : -1]
    filled = batches.groupBy(*by).applyInPandas(_fill(folds), f"{fields}, starts array<bigint>")
    order = list(dict.fromkeys([tie or group, group]))
    placed = ranked(sizes, [*by, "size"], order, "_i", hot_rows=hot_rows)
    joined = placed.join(filled.drop("groups"), [*by, "size"])
    return joined.withColumn("fold", _slot(folds)).select(
        *keys, group, F.col("size").alias("n"), "fold"
    )


def _slot(folds: int):
    """Fold of the ``_i``-th group of a size, from the loads ``starts`` before that size.

    Group i goes to the i-th smallest (starts[f] + j * size, f).  A slot (f, j) has rank
    sum over folds g of how many of g's slots come no later, so the fold holding rank i is the one
    for which some j gives exactly i.  j lies within ``folds`` of i's share, found from the level.
    """
    f_list = F.sequence(F.lit(0), F.lit(folds - 1))

    def rank(fold, j):
        level = F.get("starts", fold) + j * F.col("size")

        def earlier(acc, g):
            start = F.get("starts", g)
            gap = level - start
            steps = F.floor(gap / F.col("size")).cast("long")
            even = steps * F.col("size") == gap
            n = F.when(gap < 0, 0).otherwise(
                steps + F.when(even & (g > fold), 0).otherwise(1)
            )
            return acc + n.cast("long")

        return F.aggregate(f_list, F.lit(0).cast("long"), earlier)

    def holds(fold):
        # Slots of ``fold`` have strictly increasing ranks; bisect j in [0, i).
        def step(state, _):
            mid = F.floor((state["lo"] + state["hi"]) / 2).cast("long")
            small = rank(fold, mid) < F.col("_i")
            return F.struct(
                F.when(small, mid + 1).otherwise(state["lo"]).alias("lo"),
                F.when(small, state["hi"]).otherwise(mid).alias("hi"),
            )

        start = F.struct(F.lit(0).cast("long").alias("lo"), F.col("_i").cast("long").alias("hi"))
        steps = F.sequence(F.lit(1), F.ceil(F.log2(F.col("_i") + 1)).cast("int") + 1)
        found = F.aggregate(steps, start, step)
        return rank(fold, found["lo"]) == F.col("_i")

    return F.element_at(F.filter(f_list, holds), 1)


# Seeds of the repeated partitions.
PARTITION_SEEDS = (17, 29)


def partition_folds(df: DataFrame, label: str, group: str, partitions: int = 3) -> DataFrame:
    """Generator-paired folds for every partition: (partition, group, label, fold).

    Fold f tests one packed fold of the real groups and one whole generator, rotated by the
    partition.  Partition 0 breaks size ties by name, later ones by a seeded hash.
    """
    sizes = group_sizes(df, [label], group).withColumn(
        "partition", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1)))
    )
    facts = df.select(label, group).distinct().groupBy(label).count().collect()  # two rows
    count = {r[label]: r["count"] for r in facts}
    generators = count.get(1, 0)
    if generators < 2:
        raise ValueError("needs at least two generators")
    if count.get(0, 0) < generators:
        raise ValueError("needs at least as many real groups as generators")
    p = F.col("partition")
    seed = F.element_at(
        F.array(*map(F.lit, PARTITION_SEEDS)), (F.greatest(p, F.lit(1)) - 1) % len(PARTITION_SEEDS) + 1
    )
    tie = F.when(p == 0, F.col(group)).otherwise(seeded_hash(seed, F.col(group)))
    real = sizes.where(F.col(label) == 0).withColumn("_t", tie)
    packed = greedy_folds(real, ["partition"], group, generators, "_t").select(
        "partition", group, F.lit(0).alias(label), F.col("fold").cast("int").alias("fold")
    )
    index = ranked(sizes.where(F.col(label) == 1), ["partition"], [group], "_i")
    spoof = index.select(
        "partition",
        group,
        F.lit(1).alias(label),
        F.pmod(F.col("_i") - 1 - p, F.lit(generators)).cast("int").alias("fold"),
    )
    return packed.unionByName(spoof)


def _spread_fill(folds: int):
    """Walk of :func:`share_folds`: given (real, spoof, groups) per key, the fold of the i-th group of each pair.

    One row ``at`` = i a group of the lead, and a row ``at`` = -1 with the lead's length and the cycle that
    all later groups follow.
    """

    def spread(load: list[list[int]], total: list[int]) -> float:
        """Mean over the classes of the deviation of the folds' shares; loads count from the emptiest fold."""
        out = 0.0
        for c in (0, 1):
            low = min(x[c] for x in load)
            shares = [(x[c] - low) / max(total[c], 1) for x in load]
            mean = sum(shares) / folds
            out += math.sqrt(sum((x - mean) ** 2 for x in shares) / folds)
        return round(out / 2, 12)

    def choice(load: list[list[int]], real: int, spoof: int, total: list[int]) -> int:
        def outcome(f: int) -> tuple[float, int, int]:
            after = [[x[0] + real, x[1] + spoof] if k == f else x for k, x in enumerate(load)]
            return spread(after, total), sum(load[f]), f

        return min(map(outcome, range(folds)))[2]

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(
            zip(batch["real"].tolist(), batch["spoof"].tolist(), batch["groups"].tolist()),
            key=lambda p: (-abs(p[0] - p[1]), -(p[0] + p[1]), -p[0]),
        )
        total = [sum(r * n for r, _, n in pairs), sum(s * n for _, s, n in pairs)]
        load, out = [[0, 0] for _ in range(folds)], []
        for real, spoof, groups in pairs:
            taken, picks, seen, cycle = [0] * folds, [], {}, []
            while len(picks) < groups:
                # Equal groups, and what decides depends on differences of loads alone: a state that comes
                # back repeats all that followed it.
                low = min(taken)
                state = tuple(t - low for t in taken)
                if state in seen:
                    cycle, picks = picks[seen[state] :], picks[: seen[state]]
                    break
                seen[state] = len(picks)
                now = [[x[0] + t * real, x[1] + t * spoof] for x, t in zip(load, taken)]
                picks.append(choice(now, real, spoof, total))
                taken[picks[-1]] += 1
            rest = groups - len(picks)
            for f in range(folds):
                n = picks.count(f)
                if cycle:
                    n += rest // len(cycle) * cycle.count(f) + cycle[: rest % len(cycle)].count(f)
                load[f] = [load[f][0] + n * real, load[f][1] + n * spoof]
            out.append((real, spoof, -1, len(picks), cycle))
            out += [(real, spoof, i, f, []) for i, f in enumerate(picks)]
        walked = pd.DataFrame(out, columns=["real", "spoof", "at", "value", "cycle"])
        for key in batch.columns.difference(["real", "spoof", "groups"]):
            walked[key] = batch[key].iloc[0]
        return walked

    return run


def share_folds(
    counts: DataFrame, keys: list[str], group: str, folds: int, tie: str | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Folds with close class shares, per ``keys``: groups in order of the difference of their class counts, largest
    first, each to the fold that leaves the least spread of class shares over the folds, then the one with the fewest
    rows, then the first.

    ``counts`` has one row per (keys, group) with ``real`` and ``spoof``.  Groups of equal counts are
    interchangeable, so the walk goes over distinct (real, spoof) pairs, the larger ones first where differences
    tie: their number is at most about (rows)^(2/3), and the folds that many equal groups take become
    periodic once the folds are level.  Every group then finds its fold by its rank (by ``tie``, then
    name) among its equals.  Returns (keys, group, n, fold).
    """
    counts = counts if keys else counts.withColumn("_k", F.lit(0))
    by = keys or ["_k"]
    pair = [*by, "real", "spoof"]
    distinct = counts.groupBy(*pair).agg(F.count("*").alias("groups"))
    fields = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in pair)
    walked = distinct.groupBy(*by).applyInPandas(
        _spread_fill(folds), f"{fields}, at bigint, value bigint, cycle array<bigint>"
    )
    order = list(dict.fromkeys([tie or group, group]))
    placed = ranked(counts, pair, order, "_i", hot_rows=hot_rows).withColumn("at", F.col("_i") - 1)
    cycles = walked.where("at < 0").select(*pair, F.col("value").alias("_lead"), "cycle")
    leads = walked.where("at >= 0").select(*pair, "at", "value")
    met = placed.join(cycles, pair).join(leads, [*pair, "at"], "left")
    turn = F.get("cycle", ((F.col("at") - F.col("_lead")) % F.size("cycle")).cast("int"))
    fold = F.when(F.col("value").isNotNull(), F.col("value")).otherwise(turn).cast("int")
    return met.select(*keys, group, (F.col("real") + F.col("spoof")).alias("n"), fold.alias("fold"))


def stratified_group_folds(df: DataFrame, label: str, group: str, folds: int, seed: int) -> DataFrame:
    """Group folds with close class shares, mixed groups included; equal groups are dealt by a seeded hash."""
    counts = group_table(df, label, group).withColumn("_t", seeded_hash(seed, F.col(group)))
    return share_folds(counts, [], group, folds, "_t")


def nested_folds(
    df: DataFrame, label: str, group: str, outer: int, inner: int, seed: int
) -> DataFrame:
    """(outer, inner, group): inner folds built from the outer training side alone, for all outer
    folds in one pass over the group table."""
    counts = group_table(df, label, group)
    held = stratified_group_folds(df, label, group, outer, seed).select(
        group, F.col("fold").alias("_held")
    )
    every = counts.join(held, group).withColumn(
        "outer", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))
    )
    train = every.where(F.col("outer") != F.col("_held")).withColumn(
        "_t", seeded_hash(F.col("outer") + (seed + 1), F.col(group))
    )
    out = share_folds(train, ["outer"], group, inner, "_t")
    return out.select("outer", F.col("fold").alias("inner"), group)


def completeness(
    scores: DataFrame, keys: list[str], clips: DataFrame, expected: DataFrame
) -> DataFrame:
    """Clips without exactly one finite score per entry of ``expected`` (distinct ``keys``).

    ``expected`` is the short list of (model, partition) combinations.
    """
    ok = ~F.isnan("score") & (F.abs("score") < float("inf")) & F.col("score").isNotNull()
    seen = scores.groupBy("clip_id", *keys).agg(
        F.count("*").alias("rows"), F.count_if(ok).alias("finite")
    )
    bad = seen.where("rows <> 1 OR finite <> 1").select("clip_id", *keys, "rows", "finite")
    full = seen.groupBy("clip_id").agg(F.count("*").alias("found"))
    n = expected.select(*keys).distinct().agg(F.count("*")).scalar()
    short = (
        clips.join(full, "clip_id", "left")
        .where(F.coalesce("found", F.lit(0)) < n)
        .select("clip_id", *[F.lit(None).cast(scores.schema[k].dataType).alias(k) for k in keys],
                F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("finite"))
    )
    return bad.unionByName(short)

