"""Manifests, score tables, templates, protocols, sinks and the feature store."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from clipscore.operators import joins
from clipscore.sources import listing, manifest, sinks, store


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "filename string")


def test_manifest_with_byte_order_mark(spark, tmp_path):
    path = write(tmp_path, "m.csv", "﻿filename,label,group\n a.wav , Real ,g1\nb.wav,FAKE, g2\nc.wav,bona fide,g3\n")
    rows, problems = manifest.read_manifest(spark, path, names(spark, "a.wav", "b.wav", "c.wav"))
    assert sorted(map(tuple, rows.collect())) == [("a.wav", 0, "g1"), ("b.wav", 1, "g2"), ("c.wav", 0, "g3")]
    assert problems.isEmpty()
    tsv = write(tmp_path, "m.tsv", "filename\tlabel\na.wav\t0\nb.wav\t1\n")
    rows, _ = manifest.read_manifest(spark, tsv)
    assert rows.columns == ["filename", "label"] and rows.count() == 2


@pytest.mark.parametrize(
    "body, reason",
    [
        (",real,g\nb.wav,fake,h\n", "invalid"),
        ("a.wav,maybe,g\nb.wav,fake,h\n", "invalid"),
        ("a.wav,real,\nb.wav,fake,h\n", "group"),
        ("a.wav,real,g\na.wav,fake,h\n", "duplicate"),
        ("a.wav,real,g\nb.wav,real,h\n", "both classes"),
        ("a.wav,real,g\nz.wav,fake,h\n", "missing audio"),
    ],
)
def test_manifest_problems(spark, tmp_path, body, reason):
    path = write(tmp_path, "m.csv", "filename,label,group\n" + body)
    listed = names(spark, "a.wav", "b.wav")
    with pytest.raises(ValueError, match=reason):
        manifest.read_manifest(spark, path, listed)
    good, problems = manifest.read_manifest(spark, path, listed, mode="quarantine")
    assert any(reason in r["reason"] for r in problems.collect())
    assert set(r["filename"] for r in good.collect()) <= {"a.wav", "b.wav"}


def test_manifest_needs_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="lacks columns"):
        manifest.read_manifest(spark, write(tmp_path, "m.csv", "file,label\na,real\n"))


def test_lines_number_the_file(spark, tmp_path):
    path = write(tmp_path, "m.csv", "filename,label\na.wav,real\nb.wav,fake\n")
    got = manifest.with_lines(manifest.read_delimited(spark, path)).collect()
    assert {r["filename"]: r["line"] for r in got} == {"a.wav": 2, "b.wav": 3}


def test_lines_over_blocks_and_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for f, n in (("x.csv", 900), ("y.csv", 400), ("z.csv", 0)):
        (folder / f).write_text("filename,label\n" + "".join(f"{f}{i},real\n" for i in range(n)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        read = manifest.with_lines(manifest.read_delimited(spark, str(folder)))
        got = {r["filename"]: (r["source_file"].rsplit("/", 1)[1], r["line"]) for r in read.collect()}
        assert manifest.read_delimited(spark, str(folder)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"{f}{i}": (f, i + 2) for f, n in (("x.csv", 900), ("y.csv", 400)) for i in range(n)}


def test_rejects_carry_their_line(spark, tmp_path):
    path = write(tmp_path, "m.csv", "filename,label,group\na.wav,real,g\nb.wav,maybe,h\nc.wav,fake,\nd.wav,fake,k\nd.wav,fake,k\n")
    _, problems = manifest.read_manifest(spark, path, names(spark, "a.wav", "b.wav", "c.wav", "d.wav"), mode="quarantine")
    assert {(r["item"], r["line"]) for r in problems.collect()} == {("b.wav", 3), ("c.wav", 4), ("d.wav", None)}
    with pytest.raises(ValueError, match="line=3"):
        manifest.read_manifest(spark, path)


@pytest.mark.parametrize("value", ["nan", "inf", "-0.01", "1.01", "", "x"])
def test_external_scores_reject(spark, tmp_path, value):
    path = write(tmp_path, "s.tsv", f"filename\tcm-score\na.wav\t0.25\nb.wav\t{value}\n")
    with pytest.raises(ValueError):
        manifest.read_scores(spark, path, "second-score")
    good, rejects = manifest.read_scores(spark, path, "second-score", "quarantine")
    assert [tuple(r) for r in good.collect()] == [("a.wav", 0.25)]
    assert rejects.count() == 1


def test_external_score_columns_and_duplicates(spark, tmp_path):
    path = write(tmp_path, "s.csv", "filename,score,second-score\na.wav,0.9,0.5\n")
    assert manifest.read_scores(spark, path, "second-score")[0].first()["score"] == 0.5
    twice = write(tmp_path, "d.csv", "filename,score\na.wav,0.9\na.wav,0.5\n")
    with pytest.raises(ValueError, match="duplicate"):
        manifest.read_scores(spark, twice, "second-score")
    with pytest.raises(ValueError, match="no scores"):
        manifest.read_scores(spark, write(tmp_path, "e.csv", "filename,score\n"), "x")
    with pytest.raises(ValueError, match="needs one of"):
        manifest.read_scores(spark, write(tmp_path, "c.csv", "filename,points\na,1\n"), "x")


def test_score_pairs(spark, tmp_path):
    head = "filename\tlabel\tgroup\tp\ts\n"
    path = write(tmp_path, "p.tsv", head + " a.wav \treal\t g \t0.1\t0.2\nb.wav\tspoof\th\t0.3\t0.4\n")
    rows, _ = manifest.read_score_pairs(spark, path, "p", "s", names(spark, "a.wav", "b.wav"))
    assert sorted(map(tuple, rows.collect())) == [("a.wav", 0, "g", 0.1, 0.2), ("b.wav", 1, "h", 0.3, 0.4)]
    for body in ("a.wav\treal\tg\t0.1\t1.2\n", "a.wav\treal\t\t0.1\t0.2\n", "a.wav\treal\tg\t0\t0\na.wav\tfake\tg\t0\t0\n"):
        with pytest.raises(ValueError):
            manifest.read_score_pairs(spark, write(tmp_path, "q.tsv", head + body), "p", "s")


def test_template_order(spark, tmp_path):
    path = write(tmp_path, "t.csv", "filename\tcm-score\nc.wav\t0\na.wav\t0\nb.wav\t0\n")
    template = manifest.read_template(spark, path)
    out = manifest.ordered_by_template(names(spark, "a.wav", "b.wav", "c.wav"), template)
    assert [r["filename"] for r in out.orderBy("ord").collect()] == ["c.wav", "a.wav", "b.wav"]
    for wrong in (("a.wav", "b.wav"), ("a.wav", "b.wav", "c.wav", "d.wav")):
        with pytest.raises(ValueError, match="differ"):
            manifest.ordered_by_template(names(spark, *wrong), template)


def test_protocol(spark, tmp_path):
    ids = [f"T_{i:010d}" for i in range(4)]
    lines = [
        f"S1 {ids[0]} F - - - - - bonafide -", f"S2 {ids[1]} M c q s n A01 spoof -", "",
        f"S3 {ids[2]} M c q s n A02 spoof -", f"S3 {ids[3]} M c q s n A09 spoof -",
    ]
    listed = names(spark, *[f"{i}.flac" for i in ids[:3]])
    path = write(tmp_path, "p.txt", "﻿" + "\n".join(lines) + "\n")
    rows, _ = manifest.build_protocol_manifest(spark, path, listed, "corpus")
    got = {r["filename"]: (r["label"], r["grp"]) for r in rows.collect()}
    assert got == {
        f"{ids[0]}.flac": (0, "corpus:real:S1"), f"{ids[1]}.flac": (1, "corpus:spoof:A01"),
        f"{ids[2]}.flac": (1, "corpus:spoof:A02"),
    }
    s = manifest.manifest_summary(rows).first()
    assert (s["clips"], s["real"], s["synthetic"], s["groups"], s["families"]) == (3, 1, 2, 3, 'A01,A02')
    for bad in ("S1 ../x F - - - - - bonafide -", f"S1 {ids[0]} F - - - - bonafide -", f"S1 {ids[0]} F - - - - - odd -"):
        with pytest.raises(ValueError):
            manifest.build_protocol_manifest(spark, write(tmp_path, "b.txt", bad + "\n"), listed, "c")
    twice = "\n".join([lines[0], lines[0], lines[1]])
    with pytest.raises(ValueError, match="duplicate"):
        manifest.build_protocol_manifest(spark, write(tmp_path, "d.txt", twice), listed, "c")


def test_scan_and_listing_rules(spark, tmp_path):
    for name in ("b.WAV", "A.flac", "c.txt", "sub/d.mp3"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 5)
    files = listing.scan_audio(spark, str(tmp_path))
    assert {r["filename"] for r in files.collect()} == {"b.WAV", "A.flac", "d.mp3"}
    listing.require_listing(files)
    (tmp_path / "sub" / "A.flac").write_bytes(b"y")
    with pytest.raises(ValueError, match="duplicate basename"):
        listing.require_listing(listing.scan_audio(spark, str(tmp_path)))
    with pytest.raises(ValueError, match="no supported"):
        listing.require_listing(files.where("false"))


def test_predictions_sink(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", 0.5), (1, "a", 1.0), (3, "c", 0.6590625)], "ord long, filename string, score double")
    sinks.write_predictions(rows, str(tmp_path / "out"), single_file=True)
    part = next((tmp_path / "out").glob("part-*.csv"))
    want = ["filename\tcm-score", "a\t1.000000", "b\t0.500000", f"c\t{0.6590625:.6f}"]
    assert part.read_text().splitlines() == want
    with pytest.raises(ValueError):
        sinks.write_predictions(rows.withColumn("score", F.lit(1.5)), str(tmp_path / "bad"))
    inputs = spark.createDataFrame([(str(tmp_path / "out" / "x.wav"),)], "path string")
    with pytest.raises(ValueError, match="overwrite"):
        sinks.require_fresh(inputs, str(tmp_path / "out"))


def test_score_text_equals_exact_formatting(spark):
    import random

    rng = random.Random(3)
    values = [rng.random() for _ in range(3000)] + [k / 128 for k in range(129)] + [k / 1000003 for k in range(200)]
    values += [(2 * k + 1) / 2e6 for k in range(0, 999_999, 997)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", sinks.score_text(F.col("v")).alias("six"), sinks.score_text(F.col("v"), 8).alias("eight"))
    for r in got.collect():
        assert r["six"] == f"{r['v']:.6f}" and r["eight"] == f"{r['v']:.8f}"


def test_split_and_oof_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "g", "train"), ("b", 1, "h", "test")], "filename string, label int, grp string, side string")
    sinks.write_splits(rows, str(tmp_path / "s"), str(tmp_path / "m.csv"))
    back = spark.read.csv(str(tmp_path / "s" / "test"), header=True).collect()
    assert [tuple(r) for r in back] == [("b", "synthetic", "h")]
    with pytest.raises(ValueError, match="overwrite"):
        sinks.write_splits(rows, str(tmp_path / "s"), str(tmp_path / "s" / "train"))
    oof = spark.createDataFrame([("a", 0, 0.123456789), ("a", 1, 0.5)], "clip_id string, partition int, score double")
    sinks.write_oof(oof, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).where("partition = 0").first()["score"] == 0.12345679
    sinks.write_json(rows.limit(1), str(tmp_path / "j"))
    text = next((tmp_path / "j").glob("part-*.json")).read_text()
    assert json.loads(text)["filename"] == "a"


def test_store_extracts_only_what_is_missing(spark, tmp_path):
    def listed(*rows):
        return spark.createDataFrame(rows, "path string, length long, modificationTime string")

    calls = []

    def extract(todo):
        calls.append(sorted(r["path"] for r in todo.collect()))
        return todo.select("identity", F.array(F.col("length").cast("float")).alias("vector"))

    first = listed(("a", 1, "t"), ("b", 2, "t"))
    out = store.extend_store(spark, str(tmp_path), first, "1", "base", extract)
    assert {r["path"]: r["vector"] for r in out.collect()} == {"a": [1.0], "b": [2.0]}
    second = listed(("b", 2, "t"), ("a", 5, "t"), ("c", 3, "t"))
    out = store.extend_store(spark, str(tmp_path), second, "1", "base", extract)
    assert {r["path"]: r["vector"] for r in out.collect()} == {"a": [5.0], "b": [2.0], "c": [3.0]}
    store.extend_store(spark, str(tmp_path), second, "2", "base", extract)
    assert calls == [["a", "b"], ["a", "c"], ["a", "b", "c"]]


def test_store_keeps_rejects(spark, tmp_path):
    listed = spark.createDataFrame([(p, n, "t") for p, n in (("a", 1), ("b", 2), ("c", 3))], "path string, length long, modificationTime string")
    calls = []

    def extract(todo):
        calls.append(sorted(r["path"] for r in todo.collect()))
        bad = F.when(F.col("path") == "b", "odd header")
        return todo.select("identity", F.array(F.col("length").cast("float")).alias("vector"), bad.alias("reason"))

    for _ in range(2):
        out = {r["path"]: (r["vector"], r["reason"]) for r in store.extend_store(spark, str(tmp_path), listed, "1", "base", extract).collect()}
        assert out == {"a": ([1.0], None), "b": (None, "odd header"), "c": ([3.0], None)}
    assert calls == [["a", "b", "c"], []]
    target = f"{tmp_path}/view=base/code=1"
    spark.read.parquet(target).write.mode("append").parquet(f"{tmp_path}/twice/view=base/code=1")
    spark.read.parquet(target).write.mode("append").parquet(f"{tmp_path}/twice/view=base/code=1")
    assert store.compacted(spark, f"{tmp_path}/twice", "1", "base", f"{tmp_path}/once").count() == 3


def test_spot_check(spark):
    rows = spark.createDataFrame([(i, f"p{i}", [float(i)] * 3) for i in range(7)], "pos long, path string, vector array<double>")
    files = spark.createDataFrame([("p0", 1), ("p1", 2)], "path string, modificationTime long")

    def recompute(df):
        return df.select("pos", F.array_repeat(F.col("pos").cast("double"), 3).alias("vector"))

    assert store.spot_check(rows, files, F.lit(5), recompute) == [0, 1, 3, 4, 6]
    with pytest.raises(ValueError, match="changed"):
        store.spot_check(rows, files, F.lit(1), recompute)
    with pytest.raises(ValueError, match="differ"):
        store.spot_check(rows, files, F.lit(5), lambda df: recompute(df.where("pos <> 3")))


def test_checksum_and_bundle(spark, tmp_path):
    import hashlib

    path = write(tmp_path, "m.csv", "filename,label\n")
    assert store.checksum(spark, path).first()["sha256"] == hashlib.sha256(b"filename,label\n").hexdigest()
    good = {"version": 2, "kind": "base", "feature_names": ["a"], "metadata_real_weight": 0.05}
    store.require_bundle(good, 2, "base", ("a",))
    for change in ({"version": 1}, {"kind": "x"}, {"feature_names": ["b"]}, {"metadata_real_weight": 2}):
        with pytest.raises(ValueError):
            store.require_bundle(good | change, 2, "base", ("a",))


def test_leakage(spark):
    def side(*rows):
        return spark.createDataFrame(rows, "filename string, grp string")

    found = joins.leakage(side(("a", "g"), ("b", "h")), side(("a", "i"), ("c", "h")), "filename", "grp")
    assert sorted(map(tuple, found.collect())) == [("file", "a"), ("group", "h")]


def test_missing_features_of_pages_that_share_urls(spark, tmp_path):
    """Pages of one URL and size, and pages without text, are clips of their own."""
    import duckdb

    from clipscore.catalog import all_oracles, all_queries

    urls = ["https://a.example/x.wav", "https://a.example/y.mp3"]
    rows = [(i, urls[i % 2], None if i % 31 == 1 else "<p>same</p>") for i in range(140)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, all_queries()["a18_missing_features"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(con.execute(all_oracles()["a18_missing_features"]).fetchall())
