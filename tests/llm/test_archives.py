"""WARC archives, conversation tries and vector codes against plain Python and their own SQL."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clipscore.llm import common, conversation_trie, vector_codes, warc

SF = "/root/testdata/sf0.001"


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, data in tables.items():
        con.register(name, data)
    rel = con.sql(sql)
    return rel.columns, in_order(rel.fetchall())


# archives ----------------------------------------------------------------------------------------


def pages():
    rng = random.Random(3)
    long_ = ["x" * 1000, "<p>" + "é" * 600, "".join(rng.choice("ab <>\r\n") for _ in range(5000))]
    rows = [(i, f"http://h{i % 7}.example/{i}", rng.choice([*long_, "short", "x" * 999, "", None, str(rng.random()) * 90])) for i in range(80)]
    rows += [(500, None, long_[0]), (501, "http://a/\r\nWARC-Type: evil", "y" * 2000), (502, "http://ü/%0D", "WARC/1.1\r\n\r\n" * 300), (503, "u", "z" * 3_000_000)]
    rows += [(None, "http://none", long_[1]), (None, "http://none", "w" * 1500), rows[79], rows[79], (499, "http://other", long_[0]), (500, "http://again", long_[0])]
    return rows


def plain_archive(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        again = len(data) >= 1000 and same and max(same) != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return in_order(out)


def page_frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    return df.withColumns({c: F.lit(1) for c in ("payload", "same", "rows", "latest", "file", "offset", "refers_to")})


@pytest.mark.parametrize("hot", [1, 100_000])
def test_archives_equal_plain_python(spark, monkeypatch, hot):
    monkeypatch.setattr(warc, "attach", lambda *a: common.attach(*a, hot_keys=hot))
    assert in_order(warc.archive(page_frame(spark, pages())).collect()) == plain_archive(pages())
    assert warc.archive(page_frame(spark, [])).count() == 0


def test_archive_files_index_and_selected_reads(spark, tmp_path):
    folder = f"file:{tmp_path}/w"
    index = warc.write_archives(page_frame(spark, pages()), folder, roll_bytes=2000)
    rows = index.collect()
    files = {p.name: p.read_bytes() for p in Path(f"{tmp_path}/w").glob("*.warc.gz")}
    assert len(files) > 4 and {r.file for r in rows} == set(files)
    for name, data in files.items():
        spans = sorted((r.offset, r.length) for r in rows if r.file == name)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) == len(data)
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")  # members make one gzip file
        assert zlib.decompressobj(31).decompress(data[spans[0][0] :]).count(b"WARC-Record-ID") == 1
    picked = warc.read_records(index.where("page_id >= 500"), folder)
    got = {(r.page_id, r.record_type): r for r in picked.collect()}
    assert {p for p, _ in got} == {500, 501, 502, 503}
    assert bytes(got[503, "response"].payload) == b"z" * 3_000_000 and got[500, "response"].payload is not None
    assert got[501, "response"].url == "http://a/%0D%0AWARC-Type: evil" and got[502, "response"].url == "http://ü/%0D"
    revisit = warc.read_records(index.where("page_id = 499"), folder).first()
    assert (revisit.record_type, revisit.refers_to, revisit.payload, revisit.payload_bytes) == ("revisit", 500, None, 1000)


def test_neighbouring_ranges_share_a_read():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 100, 5), ("a", 10_000, 5), ("b", 0, 5), ("b", 5, 9_000), ("b", 9_005, 5)]
    assert warc.ranges(rows, gap=90, chunk=500) == [("a", 0, 105, 3), ("a", 10_000, 10_005, 1), ("b", 0, 5, 1), ("b", 5, 9_005, 1), ("b", 9_005, 9_010, 1)]


def test_damaged_records_are_noticed():
    good = warc.record("response", 1, "u", b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.parsed(good)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parsed(good.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        warc.parsed(good[:-2])


@pytest.mark.parametrize("hot_keys", [2, 5, 100_000])
def test_attach_is_a_left_join(spark, hot_keys):
    rows = [(k, i) for i, k in enumerate([None] * 30 + ["a"] * 50 + ["b"] * 3 + ["c"])]
    facts = [(None, 30, "n", 1), ("a", 50, "A", 2), ("b", 3, None, 3), ("d", 1, "D", 4)]
    got = common.attach(spark.createDataFrame(rows, "k string, i int"), spark.createDataFrame(facts, "k string, w long, x string, y int"), "k", "w", hot_keys)
    known = {k: (x, y) for k, _, x, y in facts}
    assert in_order(got.collect()) == in_order((k, i, *known.get(k, (None, None))) for k, i in rows)


# conversations -----------------------------------------------------------------------------------


def plain_trie(rows):
    own: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t for *_, t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    nodes: dict = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids: dict = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    words = lambda path: len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
    out, totals = [], {}
    for path in sorted(nodes, key=len, reverse=True):
        below = [totals[k] for k in kids.get(path, [])]
        totals[path] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(nodes[path]) - 1) * words(path))
        ends = ",".join(str(c) for c in sorted(nodes[path]) if len(rebuilt[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(nodes[path]), len(path), parent, len(nodes[path]), len(below), *totals[path], hashlib.sha256(ends.encode()).hexdigest()))
    return in_order(out)


def conversations():
    rng = random.Random(8)
    say = lambda n: [(rng.choice(["user", "assistant"]), rng.choice(["a b", "b  c\td", "", "日本 x", "long " * 50])) for _ in range(n)]
    shared, rows = say(7), []
    for c in range(120):
        turns = shared[: rng.randint(0, 7)] + say(rng.randint(0, 5)) if c % 3 else shared
        turns = turns or say(1)
        rows += [(c, i * 3, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(c, t, "user", "alone") for c in (401, 402, 403, 404, 405) for t in (1,)]  # no first of their family
    rows += [(700, i, "user", f"turn {i % 5}") for i in range(12)] + [(701, i, "user", f"turn {i % 5}") for i in range(9)]
    rows += [(800, None, "user", "first"), (800, None, None, None), (800, 2, "user", "tie"), (800, 2, "user", "tie"), (800, 2, "bot", "tie"), (None, 1, "user", "lost"), rows[5], rows[5]]
    return rows


def conversation_frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    return df.withColumns({c: F.lit(1) for c in ("depth", "kind", "pos", "ids", "head", "n", "box", "d", "path", "level", "words", "total")})


@pytest.mark.parametrize("shape", [{}, {"limit": 12, "block": 5, "hot_rows": 8}])
def test_tries_equal_plain_python(spark, shape):
    rows = conversations()
    got = in_order(conversation_trie.trie(conversation_frame(spark, rows), **shape).collect())
    assert got == plain_trie(rows)


@pytest.mark.parametrize("hot_keys", [1])
def test_tries_with_facts_that_are_shuffled(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(conversation_trie, "attach", lambda *a: common.attach(*a, hot_keys=hot_keys))
    rows = conversations()
    assert in_order(conversation_trie.trie(conversation_frame(spark, rows), limit=20, block=8).collect()) == plain_trie(rows)


@pytest.mark.parametrize("rows", [[], [(1, 1, "user", "x")], [(None, 1, "u", "x")], [(c, 0, None, None) for c in range(40)], [(-1, 0, "u", "neg")]])
def test_tries_of_tiny_tables(spark, rows):
    assert in_order(conversation_trie.trie(conversation_frame(spark, rows)).collect()) == plain_trie(rows)


def test_trie_sql_equals_plain_python():
    import pandas as pd

    rows = [r for r in conversations() if r[0] is not None]
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"})
    assert by_sql(conversation_trie.trie_sql(), conversations=table)[1] == plain_trie(rows)


def test_many_ends_pass_through_one_hash(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "_CHUNK_IDS", 3)
    ends = spark.range(1000).select(F.unhex(F.when(F.col("id") % 3 > 0, "aa").otherwise(F.hex(F.col("id")))).alias("node"), F.col("id").alias("conv_id")).repartition(7)
    got = {bytes(r.node): r.ends_sha256 for r in conversation_trie._end_digests(ends).collect()}
    want: dict = {}
    for r in ends.collect():
        want.setdefault(bytes(r.node), []).append(r.conv_id)
    assert got == {n: hashlib.sha256(",".join(map(str, sorted(c))).encode()).hexdigest() for n, c in want.items()}


# vectors -----------------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    kept = [(i, label, [float(np.float32(x)) for x in v]) for i, v, label in rows if ok(v)]
    width = -(-max((len(v) for *_, v in kept), default=1) // parts) * parts or parts
    bound = vector_codes.largest_component(width)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    ints = [[max(-bound, min(bound, int(np.floor(4096 * x)))) for x in v] + [0] * (width - len(v)) for *_, v in kept]
    w = width // parts
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for v in ints[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        books_next = [list(b) for b in books]
        for p in range(parts):
            groups: dict = {}
            for v in ints:
                groups.setdefault(near(p, part(v, p))[1], []).append(part(v, p))
            for e, members in groups.items():
                books_next[p][e] = [sum(c) // len(members) for c in zip(*members)]
        books = books_next
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(i, label, [near(p, part(v, p)) for p in range(parts)]) for (i, label, _), v in zip(kept, ints)]
    errors: dict = {}
    for _, label, found in coded:
        errors[label] = errors.get(label, 0) + sum(d for d, _ in found)
    return in_order((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), errors[label], digest) for i, label, found in coded)


def vectors(dims=16):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=dims)], int(rng.integers(0, 3))) for i in range(200)]
    rows += [(i, rows[7][1], None) for i in range(300, 360)]
    rows += [(900, None, 1), (901, [0.0, None] * (dims // 2), 1), (902, [float("nan")] * dims, 1), (903, [float("-inf")] + [0.0] * (dims - 1), 1)]
    return rows + [(-5, [-0.0] * dims, None), (-5, [1e-9] * dims, 2), (None, [0.25] * dims, 2), rows[3], rows[3]]


def vector_frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("code", "error", "rows", "ids", "labels", "words")})


@pytest.mark.parametrize("cells", [64, 1 << 20])
def test_codes_equal_plain_python(spark, monkeypatch, cells):
    monkeypatch.setattr(vector_codes, "_BLOCK_CELLS", cells)
    assert in_order(vector_codes.compress(vector_frame(spark, vectors())).collect()) == plain_codes(vectors())


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, [1.0] * 8, None)],
        [(i, [float(i % 2)] * 8, 0) for i in range(5)],
        [(i, [0.5 * i] * (i % 12), 0) for i in range(30)],  # mixed lengths, an empty one first
        [(i, [1e30 if i % 2 else -1e30, 3.0] * 4, i) for i in range(20)],
        [(1, [], 4)],
    ],
)
def test_codes_of_odd_tables(spark, rows):
    assert in_order(vector_codes.compress(vector_frame(spark, rows)).collect()) == plain_codes(rows)


def test_code_sql_equals_plain_python():
    import pandas as pd

    rows = [r for r in vectors() if r[1] is not None]
    table = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).astype({"vec_id": "Int64", "label": "Int64"})
    con = duckdb.connect()
    con.register("raw", table)
    con.sql("CREATE VIEW embeddings AS SELECT vec_id, embedding::FLOAT[] AS embedding, label FROM raw")
    assert in_order(con.sql(vector_codes.compress_sql()).fetchall()) == plain_codes(rows)
