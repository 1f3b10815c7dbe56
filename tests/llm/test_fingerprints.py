"""Syncmer fingerprints and SimHash groups against plain Python."""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pytest
import xxhash

from clipscore.llm import components, simhash, syncmers
from tests.llm.data import documents, frame, rows

TOKEN = re.compile(r"[぀-ヿ一-鿿]|[^\x20\x09-\x0d぀-ヿ一-鿿]{1,12}")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(value, seed):
    return xxhash.xxh64_intdigest(struct.pack("<q", value), seed & (1 << 64) - 1)


def plain_anchors(text):
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in TOKEN.findall(text)]
    if not h:
        return []

    def short(part):
        seed = 42
        for v in part:
            seed = chained(v, seed)
        return seed & 0xFFFFFF

    s = [signed(chained(b, chained(a, 42))) for a, b in zip(h, h[1:])]
    out = []
    for i in range(len(h) - syncmers.K + 1):
        inner = s[i : i + syncmers.K - syncmers.S + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append(short(h[i : i + syncmers.K]))
    return out or [short(h)]


def plain_fingerprints(data):
    data = sorted(((r[0], r[1] or "") for r in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for i, (doc, text) in enumerate(data):
        after, half = data[(i + 1) % len(data)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, other = map(plain_anchors, (text, edited, after))

        def like(a, b):
            return 1.0 if not a and not b else 2.0 * len(set(a) & set(b)) / (len(set(a)) + len(set(b)))

        show = lambda a: "".join(f"{x:06x}" for x in a)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(own), show(changed), like(own, changed), like(own, other)))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", ["1", "8", "40"])
def test_syncmers_equal_plain_python(spark, partitions):
    data = documents() + [(None, "no id here at all", None, None, 3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted((tuple(r) for r in syncmers.fingerprints(frame(spark, data)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_fingerprints(data)


@pytest.mark.parametrize("data", [[], [(1, "one two three four", "en", "s", 1)], [(1, None, None, None, None), (2, "", None, None, 0)]])
def test_syncmers_of_tiny_tables(spark, data):
    got = sorted((tuple(r) for r in syncmers.fingerprints(frame(spark, data)).collect()), key=str)
    assert got == plain_fingerprints(data)


def test_half_a_text_stays_alike(spark):
    got = syncmers.fingerprints(frame(spark, documents())).where("n_chars > 600").collect()
    mean = lambda name: sum(r[name] for r in got) / len(got)
    assert mean("near_edited") > 0.4 and min(r.near_edited for r in got) > 0
    assert mean("near_next") < 0.2


def test_splitters_deal_by_range(spark):
    splitters = [3, 10, 11, 40, 41, 42, 99]
    df = spark.createDataFrame([(i,) for i in range(-5, 120)], "v long")
    from pyspark.sql import functions as F

    got = dict(df.select("v", syncmers._bucket(splitters, F.col("v"))).collect())
    assert got == {v: sum(s <= v for s in splitters) for v in got}


def plain_simhash(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(data):
    fps = np.array([plain_simhash(r[1]) for r in data], np.uint64)
    up = list(range(len(data)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(data)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4).tolist():
            up[root(i)] = root(i + 1 + j)
    least: dict = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], f"{fps[i]:016x}", least.get(root(i))) for i, r in enumerate(data)]


def test_simhash_groups_equal_plain_python(spark):
    data = documents() + [(None, "only without a name", None, None, 3), (None, "word", None, None, 4)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, data)).collect()]
    assert sorted(got, key=str) == sorted(plain_groups(data), key=str)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_one_document_of_each_group_stays(spark):
    data = documents() + [(None, "only without a name", None, None, 3), (None, "word", None, None, 4)]
    kept = simhash.keep_one(frame(spark, data)).collect()
    groups = plain_groups(data)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for _, _, c in groups if c is not None})
    assert [r.text for r in kept if r.doc_id is None] == ["only without a name"]
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_one_row_of_each_group_stays_where_doc_ids_repeat_or_lack(spark):
    prose = {k: " ".join(hashlib.md5(f"{k}{i}".encode()).hexdigest() for i in range(60)) for k in "abcdef"}
    data = [(1, prose["a"], "en", "src0", 1), (1, prose["b"], "en", "src0", 1)]  # least of both groups
    data += [(2, prose["a"], "en", "src0", 1), (2, prose["c"], "en", "src0", 1), (3, prose["c"], "en", "src0", 1)]  # a copy under the id of another group's least
    data += [(None, prose["d"], "en", "src0", 1)] * 3 + [(None, prose["d"], "fr", None, None), (None, prose["e"], None, None, 1)]
    data += [(7, prose["f"], "en", "src0", 1), (7, prose["f"], "en", None, 1), (7, prose["f"], None, "src0", 1)]
    kept = [tuple(r) for r in simhash.keep_one(frame(spark, data)).collect()]
    assert sorted((str(r[0]), r[1]) for r in kept) == sorted((str(i), prose[k]) for i, k in [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e"), (7, "f")])
    again = simhash.keep_one(frame(spark, data[::-1]).repartition(3)).collect()
    assert sorted(map(str, kept)) == sorted(str(tuple(r)) for r in again)


def test_grids_meet_every_near_pair():
    rng = np.random.default_rng(1)
    masks = [np.uint64(m) for m in simhash.grid_masks()]
    assert len(masks) == 35
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    flips = np.zeros(4000, np.uint64)
    for _ in range(simhash.DISTANCE):
        flips |= np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64)
    u, v = simhash._unary(a), simhash._unary(a ^ flips)
    assert (np.bitwise_count(u ^ v) <= simhash.DISTANCE).all()
    assert np.any([(u & m) == (v & m) for m in masks], axis=0).all()


def test_dense_cells_give_a_spanning_forest():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for c in centres]))
    found = simhash.spanning_links(fps)
    assert len(found) == len(fps) - len(centres)


def test_components_of_chains_stars_and_rings(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)] + [(7, 3)]
    ring = [(i, 300 + (i - 299) % 9) for i in range(300, 309)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(chain + star + ring + ring, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100}
    assert {got[i] for i in [3, 7, *range(200, 260)]} == {3}
    assert {got[i] for i in range(300, 309)} == {300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_hold_the_cases():
    assert any(r[1] is None for r in rows()) and any(r[1] == "" for r in rows())
