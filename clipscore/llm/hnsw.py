"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, in flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clipscore.llm.common import cut
from clipscore.session import ship

NONE = -1
BAND = 4.0  # binary orders of length that one graph spans
_CELLS = 1 << 22  # numbers of the candidates' vectors held at once


@dataclass(frozen=True)
class Shape:
    """``links`` of a node on the upper layers, twice as many on the ground; ``considered`` candidates when
    links are chosen; ``beam`` nodes kept while searching; ``shard_rows`` vectors of a shard on
    average; at least ``min_shards`` shards; ``block_queries`` queries searched at once.
    """

    links: int = 16
    considered: int = 64
    beam: int = 96
    shard_rows: int = 8192
    min_shards: int = 8
    block_queries: int = 4096


@dataclass
class Graph:
    """Distinct vectors of a band in insertion order, a node's top layer, and per layer a flat array of
    ``width`` neighbours a node (NONE where there are fewer)."""

    vectors: np.ndarray
    level: np.ndarray
    layers: list[np.ndarray]


def _closest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of a from every row of b."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def _choose(x: np.ndarray, centre: np.ndarray, candidates: np.ndarray, width: int) -> np.ndarray:
    """Up to ``width`` neighbours a row: nearest first, but none that lies nearer to one chosen than to the centre.

    Free places go to the nearest of those left out.
    """
    n, c = candidates.shape
    if n > 1 and n * c * x.shape[1] > _CELLS:
        parts = np.array_split(np.arange(n), min(n, -(-n * c * x.shape[1] // _CELLS)))
        return np.concatenate([_choose(x, centre[p], candidates[p], width) for p in parts])
    real = candidates >= 0
    points = x[np.maximum(candidates, 0)]
    away = np.where(real, ((points - x[centre][:, None, :]) ** 2).sum(2), np.inf)
    order = np.argsort(away, axis=1, kind="stable")
    candidates, away, points = np.take_along_axis(candidates, order, 1), np.take_along_axis(away, order, 1), np.take_along_axis(points, order[:, :, None], 1)
    norms = (points * points).sum(2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
    taken = np.zeros((n, c), bool)
    for j in range(c):
        blocked = (taken & (between[:, j, :] < away[:, j][:, None])).any(axis=1)
        taken[:, j] = np.isfinite(away[:, j]) & ~blocked & (taken.sum(axis=1) < width)
    first = np.argsort(np.where(np.isfinite(away), ~taken, 2), axis=1, kind="stable")[:, :width]
    out = np.take_along_axis(candidates, first, 1)
    out[~np.isfinite(np.take_along_axis(away, first, 1))] = NONE
    return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=NONE)


def _link(x: np.ndarray, members: np.ndarray, width: int, considered: int) -> np.ndarray:
    """Neighbours of one layer.  Members join in doubling groups; each looks at the nearest of those already in
    and of its own group, so the first ones get the long links, as when they join one by one."""
    table = np.full((len(x), width), NONE, np.int32)
    done = 1
    while done < len(members):
        for at in range(done, min(2 * done, len(members)), 1024):
            new = members[at : min(at + 1024, 2 * done, len(members))]
            pool = members[: min(2 * done, len(members))]
            away = _closest(x[new], x[pool])
            away[pool[None, :] == new[:, None]] = np.inf
            k = min(considered, len(pool) - 1)
            near = np.argpartition(away, k - 1, axis=1)[:, :k] if k < len(pool) else np.arange(len(pool))[None, :].repeat(len(new), 0)
            chosen = _choose(x, new, pool[near].astype(np.int32), width)
            table[new] = chosen
            # The links back: a node with too many chooses again among old and new ones.
            target, source = chosen.ravel(), np.repeat(new, chosen.shape[1]).astype(np.int32)
            order = np.argsort(target, kind="stable")
            target, source = target[order][(keep := target[order] >= 0)], source[order][keep]
            for part in np.array_split(np.unique(target), max(1, len(target) // 8192)):
                low, high = np.searchsorted(target, part), np.searchsorted(target, part, side="right")
                extra = np.full((len(part), int((high - low).max(initial=0))), NONE, np.int32)
                rows = np.repeat(np.arange(len(part)), high - low)
                extra[rows, np.concatenate([np.arange(h - l) for l, h in zip(low, high)] or [[]]).astype(int)] = np.concatenate([source[l:h] for l, h in zip(low, high)] or [[]])
                old = table[part]
                extra[(extra[:, :, None] == old[:, None, :]).any(axis=2)] = NONE
                both = np.concatenate([old, extra], axis=1)
                filled = (both >= 0).sum(axis=1)
                easy = filled <= width
                packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :width]
                table[part[easy]] = packed[easy]
                for hard in np.array_split(np.flatnonzero(~easy), max(1, int((~easy).sum()) // 512)):
                    if len(hard):
                        table[part[hard]] = _choose(x, part[hard], both[hard], width)
        done = min(2 * done, len(members))
    return table


def build(vectors: np.ndarray, draw: np.ndarray, shape: Shape) -> Graph:
    """A graph over distinct vectors in the order given; ``draw`` in (0, 1] sets the levels."""
    x = np.asarray(vectors, np.float64)
    level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(shape.links)).astype(np.int32)
    layers = []
    for n in range(int(level.max(initial=0)) + 1):
        members = np.flatnonzero(level >= n)
        layers.append(_link(x, members, shape.links * (2 if n == 0 else 1), shape.considered))
    return Graph(x, level, layers)


def search(graph: Graph, queries: np.ndarray, beam: int, inner: bool = False) -> np.ndarray:
    """Nodes nearest to each query (NONE behind the last), all queries one step at a time; with ``inner`` those
    of largest inner product, without the vectors' lengths in between.

    From the top layer down a query moves to its nearest neighbour's place until none is nearer; on the ground it keeps
    the best ``beam`` nodes and opens the best unopened one until all are opened.
    """
    x, q = graph.vectors, np.asarray(queries, np.float64)
    n, rows = len(x), np.arange(len(q))
    beam = min(beam, n)
    norms = np.zeros(n) if inner else (x * x).sum(1)
    at = np.full(len(q), int(np.argmax(graph.level)))
    best = norms[at] - 2 * (x[at] * q).sum(1)
    for table in graph.layers[:0:-1]:
        moving = rows
        while len(moving):
            near = table[at[moving]]
            away = np.where(near >= 0, norms[near] - 2 * np.einsum("qkd,qd->qk", x[near], q[moving]), np.inf)
            pick = away.argmin(1)
            closest = away[np.arange(len(moving)), pick]
            better = closest < best[moving]
            moving, pick, closest, near = moving[better], pick[better], closest[better], near[better]
            at[moving], best[moving] = near[np.arange(len(moving)), pick], closest
    ids, away = np.full((len(q), beam), NONE, np.int32), np.full((len(q), beam), np.inf)
    opened, seen = np.ones((len(q), beam), bool), np.zeros((len(q), n), bool)
    ids[:, 0], away[:, 0], opened[:, 0] = at, best, False
    seen[rows, at] = True
    ground = graph.layers[0]
    active = rows
    while len(active):
        waiting = np.where(opened[active], np.inf, away[active])
        pick = waiting.argmin(1)
        going = np.isfinite(waiting[np.arange(len(active)), pick])
        active, pick = active[going], pick[going]
        if not len(active):
            break
        opened[active, pick] = True
        near = ground[ids[active, pick]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], np.where(near >= 0, near, ids[active, pick][:, None])] = True
        new = np.where(fresh, norms[near] - 2 * np.einsum("qkd,qd->qk", x[near], q[active]), np.inf)
        all_away = np.concatenate([away[active], new], 1)
        keep = np.argpartition(all_away, beam - 1, axis=1)[:, :beam]
        away[active] = np.take_along_axis(all_away, keep, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], 1), keep, 1)
        opened[active] = np.take_along_axis(np.concatenate([opened[active], ~fresh], 1), keep, 1)
    ids[~np.isfinite(away)] = NONE
    return ids


def _lifted(v: np.ndarray) -> np.ndarray:
    """One more coordinate brings all vectors to the same length: nearest is then largest inner product."""
    squares = (v * v).sum(1)
    return np.concatenate([v, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))[:, None]], axis=1)


def _orders(v: np.ndarray) -> np.ndarray:
    """Binary logarithms of the lengths (none is zero), also where a square leaves the range of a double."""
    largest, power = np.frexp(np.abs(v).max(axis=1))
    return power + np.log2(np.sqrt((np.ldexp(v, -power[:, None]) ** 2).sum(1)))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Divided by a power of two, the same for all rows, so that no length exceeds one."""
    return np.ldexp(v, -int(np.ceil(_orders(v).max())))


def _bands(orders: np.ndarray) -> np.ndarray:
    """Numbers from 0 of bands of like length, from the longest down: each takes in what lies up to BAND below its longest."""
    out = np.empty(len(orders), np.int64)
    falling = np.argsort(-orders, kind="stable")
    at = band = 0
    while at < len(falling):
        end = int(np.searchsorted(-orders[falling], BAND - orders[falling[at]], side="right"))
        out[falling[at:end]] = band
        at, band = end, band + 1
    return out


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part, each once, components as doubles."""
    v = F.col("embedding").cast("array<double>")
    whole = F.col("embedding").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.where(F.col("vec_id").isNotNull() & whole).select("vec_id", v.alias("v")).distinct()


INDEX = "shard int, ids binary, node binary, vectors binary, level binary, layers array<binary>, dim int, width int"


def index(rows: DataFrame, shards: int, shape: Shape) -> DataFrame:
    """One row a band of lengths in a shard: the graph's flat arrays, and for each of its rows vec_id and node.

    Equal vectors of a shard share a node.  The shard of a row hashes its id and vector, so that a frequent
    vector is spread; insertion order and levels hash the id.  A band is lifted by its own longest vector:
    one far longer than the rest does not press the others into a point.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "vec_id"])
        v = np.array(pdf["v"].tolist(), np.float64)
        _, first, node = np.unique(v, axis=0, return_index=True, return_inverse=True)
        turn = np.argsort(first)  # distinct vectors by first appearance
        place = np.empty(len(turn), np.int64)
        place[turn] = np.arange(len(turn))
        distinct, levels, node, ids = v[first[turn]], pdf["draw"].to_numpy()[first[turn]], place[node.ravel()], pdf["vec_id"].to_numpy(np.int64)
        band = _bands(_orders(distinct))
        out = []
        for b in range(int(band.max()) + 1):
            members, rows_in = np.flatnonzero(band == b), band[node] == b
            own = distinct[members]
            graph = build(_lifted(_scaled(own)), levels[members], shape)
            out.append({
                "shard": key[0], "ids": ids[rows_in].tobytes(), "node": np.searchsorted(members, node[rows_in]).astype(np.int32).tobytes(),
                "vectors": own.tobytes(), "level": graph.level.tobytes(), "layers": [t.tobytes() for t in graph.layers],
                "dim": v.shape[1], "width": shape.links,
            })
        return pd.DataFrame(out)

    ship(rows.sparkSession)
    draw = (F.pmod(F.xxhash64("vec_id", F.lit("level")), F.lit(1 << 30)) + 1) / float(1 << 30)
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v", draw.alias("draw"))
    return dealt.groupBy("shard").applyInPandas(run, INDEX)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shape: Shape = Shape()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows found nearest to each row whose id ``every`` divides.

    Nearness is the largest inner product, computed in doubles on the original vectors; ties go to the smaller vec_id; a
    query is no candidate of its own.  Every shard's graph is searched for every query and the
    shards' best are merged.  Rows whose vector is null, empty, zero or holds a null or non-finite component
    take no part, nor do null ids; repeated rows count once; vectors of different lengths are not
    comparable and raise an error.  An empty table gives an empty one; other columns are not looked at.

    Shards number ``rows / shard_rows``; a task holds one shard's graphs, one a band of lengths, and one
    block of queries.  The beam ranks by inner products in doubles too.
    """
    rows = cut(sound(vectors))
    n, dims = rows.agg(F.count("*"), F.countDistinct(F.size("v"))).first()
    if dims > 1:
        raise ValueError("vectors differ in length")
    shards = max(shape.min_shards, -(-n // shape.shard_rows))
    graphs = cut(index(rows, shards, shape))
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // shape.block_queries))
    all_shards, all_blocks = F.sequence(F.lit(0), F.lit(shards - 1)), F.sequence(F.lit(0), F.lit(blocks - 1))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(all_shards))
    offered = graphs.withColumn("block", F.explode(all_blocks))

    def run(key: tuple, one: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if one.empty or block.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        out = []
        for g in one.to_dict("records"):
            own = np.frombuffer(g["vectors"], np.float64).reshape(-1, g["dim"])
            ids, node = np.frombuffer(g["ids"], np.int64), np.frombuffer(g["node"], np.int32)
            layers = [np.frombuffer(t, np.int32).reshape(len(own), -1) for t in g["layers"]]
            graph = Graph(_scaled(own), np.frombuffer(g["level"], np.int32), layers)
            order = np.lexsort((ids, node))
            ids, node = ids[order], node[order]
            low, high = np.searchsorted(node, np.arange(len(own))), np.searchsorted(node, np.arange(len(own)), side="right")
            for at in range(0, len(block), 512):
                names = block["vec_id"].to_numpy(np.int64)[at : at + 512]
                q = np.array(block["v"].iloc[at : at + 512].tolist(), np.float64)
                found = search(graph, np.ldexp(q, -np.frexp(np.abs(q).max(axis=1))[1][:, None]), shape.beam, inner=True)
                for name, vector, nodes in zip(names, q, found):
                    nodes = nodes[nodes >= 0]
                    score = exact_scores(own[nodes], vector)
                    # Equal vectors share a node: of each, the k + 1 least ids suffice.
                    got = [(ids[low[m] : min(high[m], low[m] + k + 1)], s) for m, s in zip(nodes, score)]
                    near, s = np.concatenate([a for a, _ in got]), np.repeat([b for _, b in got], [len(a) for a, _ in got])
                    near, s = near[(keep := near != name)], s[keep]
                    best = np.lexsort((near, -s))[:k]
                    out.append(pd.DataFrame({"query_id": name, "vec_id": near[best], "score": s[best]}))
        return pd.concat(out)

    hits = offered.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(run, "query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in order of the components (the same whatever the batch)."""
    total = np.zeros(len(vectors))
    for j in range(len(query)):
        total += vectors[:, j] * query[j]
    return total
