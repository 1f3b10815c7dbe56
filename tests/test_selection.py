"""Sampling and fold properties, and the closed-form greedy packing against the sequential rule."""

from __future__ import annotations

import hashlib
import random
import statistics
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clipscore.operators import sampling, splits


def clips(spark, groups: dict[str, int]):
    rows, i = [], 0
    for name, n in groups.items():
        for _ in range(n):
            rows.append((i, int(name.startswith("synthetic")), name))
            i += 1
    return spark.createDataFrame(rows, "clip_id int, label int, grp string")


def sequential(sizes: dict[str, int], folds: int) -> dict[str, int]:
    load, out = [0] * folds, {}
    for name in sorted(sizes, key=lambda g: (-sizes[g], g)):
        f = load.index(min(load))
        out[name], load[f] = f, load[f] + sizes[name]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_greedy_folds_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    top = rng.choice([2, 5, 40])
    sizes = {f"g{i:03d}": rng.randint(1, top) for i in range(rng.choice([7, 60, 200]))}
    folds = rng.choice([2, 3, 5])
    table = spark.createDataFrame(list(sizes.items()), "grp string, size long")
    for hot in (10**9, 3):
        got = {r["grp"]: r["fold"] for r in splits.greedy_folds(table, [], "grp", folds, hot_rows=hot).collect()}
        assert got == sequential(sizes, folds)
        if seed > 1:
            break


def test_balanced_sample_covers_groups(spark):
    groups = {f"real:{i:02d}": 1 for i in range(12)} | {f"synthetic:{i}": 6 for i in range(4)}
    out = sampling.balanced_sample(clips(spark, groups), "label", "grp", "clip_id", 8, 7).collect()
    real = [r["grp"] for r in out if r["label"] == 0]
    spoof = [r["grp"] for r in out if r["label"] == 1]
    assert len(real) == len(set(real)) == 8
    assert len(spoof) == 8 and len(set(spoof)) == 4


def test_balanced_sample_fills_from_leftovers_under_a_hot_group(spark):
    groups = {"real:hot": 60, "real:a": 2, "real:b": 1, "synthetic:x": 5}
    for hot in (10**9, 10):
        out = sampling.balanced_sample(clips(spark, groups), "label", "grp", "clip_id", 20, 3, hot).collect()
        counts = Counter(r["grp"] for r in out)
        assert counts == {"real:hot": 17, "real:a": 2, "real:b": 1, "synthetic:x": 5}


@pytest.mark.parametrize("target", [0, 1, 5, 11, 13, 100])
def test_round_robin_equals_the_loop(spark, target):
    groups = {"a": 7, "b": 2, "c": 4, "d": 1}
    df = clips(spark, groups)
    ranked = defaultdict(list)
    for r in sampling.hash_bottom_k(df, "grp", "clip_id", 5).orderBy("rn").collect():
        ranked[r["grp"]].append(r["clip_id"])
    want, depth = [], 0
    while len(want) < target and any(len(v) > depth for v in ranked.values()):
        for g in sorted(ranked):
            if len(ranked[g]) > depth and len(want) < target:
                want.append(ranked[g][depth])
        depth += 1
    got = [r["clip_id"] for r in sampling.round_robin(df, "grp", "clip_id", 5, target).collect()]
    assert sorted(got) == sorted(want)


def test_hash_selection_ignores_input_order(spark):
    df = clips(spark, {"a": 30, "b": 30})
    first = sampling.hash_bottom_k(df, "grp", "clip_id", 4).select("clip_id").collect()
    again = sampling.hash_bottom_k(df.orderBy(F.rand(1)).repartition(5), "grp", "clip_id", 4)
    assert sorted(first) == sorted(again.select("clip_id").collect())


def test_spaced_positions_golden(spark):
    assert sampling.spaced_positions(7, 5) == [0, 1, 3, 4, 6]
    assert sampling.spaced_positions(3, 5) == [0, 1, 2]
    assert sampling.spaced_positions(9, 1) == [0]
    df = spark.range(7).select(F.lit("k").alias("k"), "id")
    for hot in (10**9, 2):
        got = sampling.evenly_spaced(df, ["k"], ["id"], 5, hot).collect()
        assert sorted(r["id"] for r in got) == [0, 1, 3, 4, 6]


def test_group_split_is_disjoint_balanced_and_repeatable(spark):
    groups = {f"real:{i}": 5 for i in range(10)} | {f"synthetic:{i}": 5 for i in range(10)}
    df = clips(spark, groups)
    split = splits.group_split(df, "label", "grp", 0.2, 42)
    sides = defaultdict(set)
    for r in split.collect():
        sides[r["side"]].add(r["grp"])
    assert not sides["train"] & sides["test"]
    assert {g.split(":")[0] for g in sides["test"]} == {"real", "synthetic"}
    counts = Counter(g.split(":")[0] for g in sides["test"])
    assert counts["real"] == counts["synthetic"] == 2
    again = splits.group_split(df.repartition(7), "label", "grp", 0.2, 42)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, split.collect()))


def test_splits_refuse_tiny_data(spark):
    few = clips(spark, {"real:a": 2, "synthetic:b": 2})
    assert splits.clip_split(few, "label", "clip_id", 0.2, 1) is None
    three = clips(spark, {"real:a": 5, "real:b": 5, "synthetic:c": 5})
    assert splits.group_split(three, "label", "grp") is None
    with pytest.raises(ValueError):
        splits.clip_split(few, "label", "clip_id", 1.0, 1)


def test_clip_split_keeps_both_classes(spark):
    df = clips(spark, {"real:a": 9, "synthetic:b": 3})
    rows = splits.clip_split(df, "label", "clip_id", 0.25, 42).collect()
    assert Counter(r["side"] for r in rows) == {"train": 9, "test": 3}
    assert {r["label"] for r in rows if r["side"] == "test"} == {0, 1}


def test_paired_folds_cover_every_row_once(spark):
    groups = {f"real:{i}": 3 + i % 4 for i in range(9)} | {f"synthetic:{i}": 4 for i in range(3)}
    df = clips(spark, groups)
    folds = splits.partition_folds(df, "label", "grp", 3).collect()
    per = defaultdict(list)
    for r in folds:
        per[(r["partition"], r["grp"])].append(r["fold"])
    assert len(per) == 3 * len(groups) and all(len(v) == 1 for v in per.values())
    for p in range(3):
        spoof = {r["grp"]: r["fold"] for r in folds if r["partition"] == p and r["label"] == 1}
        assert sorted(spoof.values()) == [0, 1, 2]
        assert spoof["synthetic:0"] == (0 - p) % 3
    with pytest.raises(ValueError):
        splits.partition_folds(df.where("grp <> 'x' AND NOT grp IN ('synthetic:1', 'synthetic:2')"), "label", "grp")


def test_nested_folds_stay_inside_the_training_side(spark):
    groups = {f"real:{i}": 2 + i % 3 for i in range(12)} | {f"synthetic:{i}": 3 for i in range(6)}
    df = clips(spark, groups)
    outer = {r["grp"]: r["fold"] for r in splits.stratified_group_folds(df, "label", "grp", 3, 42).collect()}
    inner = splits.nested_folds(df, "label", "grp", 3, 2, 42).collect()
    assert all(outer[r["grp"]] != r["outer"] for r in inner)
    assert len(inner) == 2 * len(groups)
    assert {r["inner"] for r in inner} == {0, 1}


def plain_share_folds(counts: dict, folds: int) -> dict:
    """The sequential rule, one group at a time: counts are (real, spoof) per group name."""
    total = [sum(c[k] for c in counts.values()) or 1 for k in (0, 1)]
    load, out = [[0, 0] for _ in range(folds)], {}
    for name in sorted(counts, key=lambda g: (-abs(counts[g][0] - counts[g][1]), -sum(counts[g]), -counts[g][0], g)):
        tried = []
        for f in range(folds):
            after = [[a + b * (k == f) for a, b in zip(x, counts[name])] for k, x in enumerate(load)]
            spread = sum(statistics.pstdev(x[c] / total[c] for x in after) for c in (0, 1)) / 2
            tried.append((round(spread, 12), sum(load[f]), f))
        best = min(tried)[2]
        out[name] = best
        load[best] = [a + b for a, b in zip(load[best], counts[name])]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_share_folds_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    top, folds = rng.choice([1, 3, 20]), rng.choice([2, 3, 5])
    counts = {f"g{i:03d}": (rng.randint(0, top), rng.randint(0, top)) for i in range(rng.choice([9, 80, 300]))}
    counts = {g: c if any(c) else (1, 0) for g, c in counts.items()}
    table = spark.createDataFrame([(g, *c) for g, c in counts.items()], "grp string, real long, spoof long")
    for hot in (10**9, 3)[: 2 if seed < 2 else 1]:
        got = {r["grp"]: r["fold"] for r in splits.share_folds(table, [], "grp", folds, hot_rows=hot).collect()}
        assert got == plain_share_folds(counts, folds)


def test_many_equal_groups_become_periodic(spark):
    counts = {f"a{i:04d}": (1, 0) for i in range(3001)} | {"big": (7, 90)} | {f"m{i:03d}": (2, 1) for i in range(601)}
    table = spark.createDataFrame([(g, *c) for g, c in counts.items()], "grp string, real long, spoof long")
    rows = splits.share_folds(table, [], "grp", 4).collect()
    assert {r["grp"]: r["fold"] for r in rows} == plain_share_folds(counts, 4)
    batch = pd.DataFrame({"real": [1, 2, 7], "spoof": [0, 1, 90], "groups": [10**12, 10**9, 1]})
    walked = splits._spread_fill(4)(batch)
    assert len(walked) < 2000  # steps of the walk, not groups


def test_share_folds_of_no_groups(spark):
    assert splits.share_folds(spark.createDataFrame([], "grp string, real long, spoof long"), [], "grp", 3).count() == 0


def test_split_scores_equal_ranks_of_every_seed(spark):
    groups = {f"real:{i}": 1 + i % 5 for i in range(300)} | {f"synthetic:{i}": 2 + i % 3 for i in range(200)}
    df = clips(spark, groups)
    *_, scores = splits.group_split_scores(df, "label", "grp", 0.2, 7, 12)
    got = {r["seed"]: (r["tr"], r["ts"]) for r in scores.collect()}
    for seed in range(7, 19):
        least = sorted(groups, key=lambda g: (hashlib.md5(f"{seed}:{g}".encode()).hexdigest(), g))[:100]
        want = tuple(sum(groups[g] for g in least if g.startswith(k)) for k in ("real", "synthetic"))
        assert got[seed] == want
