"""Source, sink and contract queries (A1-A20) over the stand-in manifest and listing."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipscore import views
from clipscore.catalog.common import Catalog, r6, s6, with_
from clipscore.operators import sampling, splits
from clipscore.operators.ordered import ranked
from clipscore.operators import models as Mo
from clipscore.sources import listing as L
from clipscore.sources import manifest as Mf
from clipscore.sources import sinks, store

catalog = Catalog()

# Label spellings and file suffixes cycled over the rows of the stand-in tables.
RAW = """CASE WHEN label = 0 THEN CASE clip_id % 4 WHEN 0 THEN '0' WHEN 1 THEN ' Real' WHEN 2 THEN 'BONAFIDE' ELSE 'bona fide ' END
 ELSE CASE clip_id % 4 WHEN 0 THEN '1' WHEN 1 THEN 'Synthetic ' WHEN 2 THEN ' spoof' ELSE 'FAKE' END END"""
NAME = "concat('  clip_', CAST(clip_id AS VARCHAR(20)), '.wav ')"


def raw_manifest(spark, sf):
    return views.scored(spark, sf).select(
        "clip_id",
        F.concat(F.lit("  clip_"), F.col("clip_id").cast("string"), F.lit(".wav ")).alias("filename"),
        F.expr(RAW).alias("label"),
        F.concat(F.lit(" "), "grp", F.lit(" ")).alias("group"),
    )


@catalog.add(
    "a1_read_manifest",
    with_(views.SCORED) + f" SELECT clip_id, trim({NAME}) AS filename, label, grp FROM scored",
)
def a1_read_manifest(spark, sf):
    return Mf.normalized(raw_manifest(spark, sf)).select("clip_id", "filename", "label", "grp")


@catalog.add(
    "a2_label_vocabulary",
    with_(views.SCORED)
    + f" SELECT lower(trim({RAW})) AS text, label, count(*) AS n FROM scored GROUP BY 1, 2",
)
def a2_label_vocabulary(spark, sf):
    rows = raw_manifest(spark, sf).withColumn("text", F.lower(F.trim("label")))
    return Mf.normalized(rows).groupBy("text", "label").agg(F.count("*").alias("n"))


@catalog.add(
    "a3_manifest_integrity",
    with_(
        views.SCORED,
        """m AS (SELECT clip_id, CASE WHEN clip_id % 17 = 0 THEN '' ELSE concat('clip_', CAST(clip_id AS VARCHAR)) END AS filename,
 CASE WHEN clip_id % 19 = 0 THEN NULL ELSE label END AS label, CASE WHEN clip_id % 23 = 0 THEN '' ELSE grp END AS grp FROM scored)""",
        "mm AS (SELECT * FROM m UNION ALL SELECT * FROM m WHERE clip_id % 29 = 0)",
    )
    + """ SELECT filename AS item, CASE WHEN filename = '' OR label IS NULL THEN 'invalid filename or label' ELSE 'missing group' END AS reason
 FROM mm WHERE filename = '' OR label IS NULL OR grp = ''
 UNION ALL SELECT filename, 'duplicate path' FROM mm GROUP BY filename HAVING count(*) > 1
 UNION ALL SELECT filename, 'missing audio' FROM mm WHERE filename NOT IN
  (SELECT concat('clip_', CAST(clip_id AS VARCHAR)) FROM scored WHERE clip_id % 31 <> 0)""",
)
def a3_manifest_integrity(spark, sf):
    """Planted faults: blank names, unknown labels, blank groups, repeats, absent audio."""
    i = F.col("clip_id")
    name = F.concat(F.lit("clip_"), i.cast("string"))
    rows = raw_manifest(spark, sf).select(
        i,
        F.when(i % 17 == 0, " ").otherwise(name).alias("filename"),
        F.when(i % 19 == 0, "maybe").otherwise(F.col("label")).alias("label"),
        F.when(i % 23 == 0, " ").otherwise(F.col("group")).alias("group"),
    )
    listed = views.scored(spark, sf).where(i % 31 != 0).select(name.alias("filename"))
    rows = rows.unionByName(rows.where(i % 29 == 0))
    return Mf.manifest_violations(Mf.normalized(rows), listed)


@catalog.add(
    "a3_reject_lines",
    with_(
        views.SCORED,
        """m AS (SELECT clip_id, CASE WHEN clip_id % 17 = 0 THEN NULL ELSE concat('clip_', CAST(clip_id AS VARCHAR)) END AS item,
 clip_id % 17 = 0 OR clip_id % 19 = 0 AS bad, clip_id % 23 = 0 AS lost,
 row_number() OVER (PARTITION BY clip_id % 3 ORDER BY clip_id) + 1 AS line FROM scored)""",
    )
    + """ SELECT CAST(clip_id % 3 AS INT) AS part, item, line, CASE WHEN bad THEN 'invalid filename or label' ELSE 'missing group' END AS reason
 FROM m WHERE bad OR lost""",
)
def a3_reject_lines(spark, sf):
    """The manifest as three files, read back: rejects name the file and its line."""
    i = F.col("clip_id")
    rows = raw_manifest(spark, sf).select(
        (i % 3).cast("int").alias("part"),
        i,
        F.when(i % 17 == 0, None).otherwise(F.concat(F.lit("clip_"), i.cast("string"))).alias("filename"),
        F.when(i % 19 == 0, "maybe").otherwise(F.col("label")).alias("label"),
        F.when(i % 23 == 0, None).otherwise(F.col("group")).alias("group"),
    )
    place = Mo.shared_path(spark)
    ordered = rows.repartition(3, "part").sortWithinPartitions("part", "clip_id")
    ordered.write.partitionBy("part").csv(place, header=True)
    read = Mf.with_lines(Mf.read_delimited(spark, place))
    bad = Mf.manifest_violations(Mf.normalized(read)).where("line IS NOT NULL")
    part = F.regexp_extract("source_file", r"part=(\d)", 1).cast("int")
    return bad.select(part.alias("part"), "item", "line", "reason")


@catalog.add(
    "a14_reject_lines",
    with_(
        views.SCORED,
        f"""n AS (SELECT *, row_number() OVER (PARTITION BY clip_id % 3 ORDER BY clip_id) AS line FROM scored)""",
    )
    + """ SELECT CAST(clip_id % 3 AS INT) AS part, line, CASE WHEN clip_id % 47 = 0 THEN 'needs 10 fields' WHEN clip_id % 43 = 0 THEN 'unsafe utterance id'
 ELSE 'unrecognized key' END AS reason FROM n WHERE clip_id % 47 = 0 OR clip_id % 43 = 0 OR clip_id % 53 = 0""",
)
def a14_reject_lines(spark, sf):
    """Protocol lines of three files; rejects carry the line."""
    lines = views.scored(spark, sf).select((F.col("clip_id") % 3).cast("int").alias("part"), "clip_id", F.expr(LINE).alias("value"))
    place = Mo.shared_path(spark)
    lines.repartition(3, "part").sortWithinPartitions("part", "clip_id").drop("clip_id").write.partitionBy("part").text(place)
    parsed = Mf.parse_protocol(Mf.with_lines(spark.read.text(place), first=1))
    return parsed.where("reason IS NOT NULL").select("part", "line", "reason")


SUFFIXES = (".wav", ".MP3", ".m4a", ".txt", ".ogg", ".Flac", ".csv", ".opus", ".json", ".webm")
EXT = "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES)) + " END"
TREE = f"concat(CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END, '/', lang, '/clip', CAST(doc_id AS VARCHAR(20)), {EXT})"
AUDIO = ", ".join(f"'{s}'" for s in L.AUDIO_SUFFIXES)


def tree(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", F.expr(TREE).alias("path"))


@catalog.add(
    "a4_audio_scan",
    f"""WITH t AS (SELECT {TREE} AS path, lower({EXT}) AS suffix FROM documents)
 SELECT path, suffix, row_number() OVER (ORDER BY lower(path), path) AS ord FROM t WHERE suffix IN ({AUDIO})""",
)
def a4_audio_scan(spark, sf):
    """Suffix allow-list and case-blind path order; the byte scan itself is ``scan_audio``."""
    from clipscore.functions.scores import suffix

    files = tree(spark, sf).withColumn("suffix", suffix(F.col("path")))
    files = files.where(F.col("suffix").isin(*L.AUDIO_SUFFIXES)).withColumn("low", F.lower("path"))
    return ranked(files, [], ["low", "path"], "ord").select("path", "suffix", "ord")


@catalog.add(
    "a5_duplicate_basenames",
    with_(views.CONTAINERS)
    + " SELECT list_extract(string_split(path, '/'), -1) AS filename, count(*) AS count FROM containers GROUP BY 1 HAVING count(*) > 1",
)
def a5_duplicate_basenames(spark, sf):
    return L.duplicate_names(views.containers(spark, sf))


TEXT_SCORE = """CASE clip_id % 12 WHEN 3 THEN 'nan' WHEN 5 THEN '1.01' WHEN 7 THEN 'abc' WHEN 9 THEN '-0.01' WHEN 11 THEN ''
 ELSE concat(' 0.', lpad(CAST(clip_id % 1000 AS VARCHAR(9)), 3, '0')) END"""


@catalog.add(
    "a6_external_scores",
    with_(views.SCORED)
    + f""", t AS (SELECT clip_id, CASE WHEN clip_id % 37 = 0 THEN '' ELSE concat('c', CAST(clip_id AS VARCHAR)) END AS filename,
 TRY_CAST(trim({TEXT_SCORE}) AS DOUBLE) AS s FROM scored), c AS (SELECT *, CASE WHEN filename = '' THEN 'blank filename'
 WHEN s IS NULL OR isnan(s) OR s < 0 OR s > 1 THEN 'bad score' ELSE 'ok' END AS verdict FROM t)
 SELECT verdict, count(*) AS n, {s6("coalesce(sum(CASE WHEN verdict = 'ok' THEN s END), 0)")} AS total FROM c GROUP BY verdict""",
)
def a6_external_scores(spark, sf):
    i = F.col("clip_id")
    raw = views.scored(spark, sf).select(
        F.when(i % 37 == 0, "").otherwise(F.concat(F.lit("c"), i.cast("string"))).alias("filename"),
        F.expr(TEXT_SCORE).alias("cm-score"),
    )
    parsed = Mf.parse_scores(raw, {"score": Mf.score_column(raw.columns, "other-score")})
    judged = Mf.score_violations(parsed, ["score"]).withColumn(
        "verdict", F.coalesce("reason", F.lit("ok"))
    )
    kept = F.when(F.col("verdict") == "ok", F.col("score"))
    return judged.groupBy("verdict").agg(
        F.count("*").alias("n"), r6(F.coalesce(F.sum(kept), F.lit(0.0))).alias("total")
    )


@catalog.add(
    "a7_score_pairs",
    with_(views.SCORED)
    + f""", t AS (SELECT clip_id, trim({NAME}) AS filename, label, grp, primary_score AS a,
 TRY_CAST(trim({TEXT_SCORE}) AS DOUBLE) AS b FROM scored)
 SELECT filename, label, grp, {s6('a')} AS primary_score, {s6('b')} AS secondary_score FROM t
 WHERE b IS NOT NULL AND NOT isnan(b) AND b BETWEEN 0 AND 1""",
)
def a7_score_pairs(spark, sf):
    raw = Mf.normalized(
        raw_manifest(spark, sf)
        .join(views.scored(spark, sf).select("clip_id", "primary_score"), "clip_id")
        .withColumn("second", F.expr(TEXT_SCORE.replace("label", "clip_id")))
    )
    parsed = Mf.parse_scores(raw, {"primary": "primary_score", "secondary": "second"})
    good = Mf.score_violations(parsed, ["primary", "secondary"]).where("reason IS NULL")
    return good.select(
        "filename",
        "label",
        "grp",
        r6("primary").alias("primary_score"),
        r6("secondary").alias("secondary_score"),
    )


@catalog.add(
    "a8_template_order",
    with_(views.SCORED)
    + """ SELECT concat('c', CAST(clip_id AS VARCHAR)) AS filename,
 row_number() OVER (ORDER BY md5(CAST(clip_id AS VARCHAR)), clip_id) AS ord FROM scored""",
)
def a8_template_order(spark, sf):
    named = views.scored(spark, sf).select(
        F.concat(F.lit("c"), F.col("clip_id").cast("string")).alias("filename"), "clip_id"
    )
    hashed = named.withColumn("h", sampling.name_hash(F.col("clip_id")))
    template = ranked(hashed, [], ["h", "clip_id"], "ord").select("filename", "ord")
    return Mf.ordered_by_template(named.select("filename"), template)


@catalog.add(
    "a8_template_mismatch",
    with_(views.SCORED)
    + """, l AS (SELECT CAST(clip_id AS VARCHAR) AS item FROM scored WHERE clip_id % 13 <> 0
 UNION ALL SELECT CAST(clip_id AS VARCHAR) FROM scored WHERE clip_id % 10 = 3),
 r AS (SELECT CAST(clip_id AS VARCHAR) AS item FROM scored WHERE clip_id % 11 <> 0),
 u AS (SELECT coalesce(l.item, r.item) AS item, coalesce(l.n, 0) AS nl, coalesce(r.n, 0) AS nr
 FROM (SELECT item, count(*) AS n FROM l GROUP BY item) l FULL JOIN (SELECT item, count(*) AS n FROM r GROUP BY item) r ON l.item = r.item)
 SELECT item, CASE WHEN nl = 0 THEN 'only right' WHEN nr = 0 THEN 'only left' ELSE 'duplicate' END AS reason FROM u WHERE nl <> 1 OR nr <> 1""",
)
def a8_template_mismatch(spark, sf):
    ids = views.scored(spark, sf).select(F.col("clip_id").cast("string").alias("filename"), "clip_id")
    template = ids.where("clip_id % 13 <> 0").unionByName(ids.where("clip_id % 10 = 3"))
    return Mf.name_mismatches(template, ids.where("clip_id % 11 <> 0"))


@catalog.add(
    "a9_prediction_rows",
    with_(views.SCORED)
    + """ SELECT row_number() OVER (ORDER BY clip_id) AS ord, concat('c', CAST(clip_id AS VARCHAR)) AS filename,
 printf('%.6f', primary_score) AS "cm-score" FROM scored""",
)
def a9_prediction_rows(spark, sf):
    rows = ranked(views.scored(spark, sf), [], ["clip_id"], "ord").select(
        "ord",
        F.concat(F.lit("c"), F.col("clip_id").cast("string")).alias("filename"),
        F.col("primary_score").alias("score"),
    )
    return sinks.prediction_rows(rows)


@catalog.add(
    "a9_prediction_rejects",
    with_(views.SCORED)
    + """ SELECT clip_id, 'score not finite in [0, 1]' AS reason FROM scored
 WHERE primary_score * 12e-1 > 1 OR clip_id % 41 = 0""",
)
def a9_prediction_rejects(spark, sf):
    nan = F.lit(float("nan"))
    rows = views.scored(spark, sf).select(
        "clip_id",
        F.when(F.col("clip_id") % 41 == 0, nan)
        .otherwise(F.col("primary_score") * 1.2)
        .alias("score"),
    )
    return sinks.prediction_violations(rows).select("clip_id", "reason")


@catalog.add(
    "a10_explanation_json",
    with_(views.SCORED)
    + """ SELECT clip_id, concat('{"filename":"c', CAST(clip_id AS VARCHAR), '","cm-score":"', printf('%.6f',
 CASE WHEN status = 'consistent' THEN primary_score * (1e0 - 5e-2) ELSE primary_score END), '","metadata":{"status":"', status, '"}}') AS json FROM scored""",
)
def a10_explanation_json(spark, sf):
    from clipscore.functions.scores import container_adjusted

    score = container_adjusted(F.col("primary_score"), F.col("status"))
    body = F.struct(
        F.concat(F.lit("c"), F.col("clip_id").cast("string")).alias("filename"),
        sinks.score_text(score).alias("cm-score"),
        F.struct("status").alias("metadata"),
    )
    return views.scored(spark, sf).select("clip_id", F.to_json(body).alias("json"))


@catalog.add(
    "a11_report_json",
    with_(views.SCORED)
    + """ SELECT concat('{"samples":', CAST(count(*) AS VARCHAR), ',"classes":{"real":', CAST(sum(1-label) AS VARCHAR),
 ',"synthetic":', CAST(sum(label) AS VARCHAR), '},"groups":', CAST(count(DISTINCT grp) AS VARCHAR), '}') AS json FROM scored""",
)
def a11_report_json(spark, sf):
    counts = views.scored(spark, sf).agg(
        F.count("*").alias("samples"),
        F.struct(
            F.count_if(F.col("label") == 0).alias("real"),
            F.count_if(F.col("label") == 1).alias("synthetic"),
        ).alias("classes"),
        F.count_distinct("grp").alias("groups"),
    )
    return counts.select(F.to_json(F.struct("samples", "classes", "groups")).alias("json"))


@catalog.add(
    "a12_split_manifest",
    with_(views.SCORED, splits.CLIP_SPLIT_SQL)
    + """ SELECT side, concat('c', CAST(clip_id AS VARCHAR)) AS filename,
 CASE WHEN label = 1 THEN 'synthetic' ELSE 'real' END AS label, grp AS "group" FROM parted""",
)
def a12_split_manifest(spark, sf):
    rows = views.scored(spark, sf).withColumn(
        "filename", F.concat(F.lit("c"), F.col("clip_id").cast("string"))
    )
    return sinks.split_rows(splits.clip_split(rows, "label", "clip_id", 0.2, 42))


@catalog.add(
    "a13_oof_rows",
    with_(views.SCORED)
    + """ SELECT concat('c', CAST(clip_id AS VARCHAR)) AS filename, label, grp AS "group", CAST(clip_id % 5 AS INT) AS fold,
 printf('%.8f', primary_score) AS primary_text, printf('%.8f', secondary_score) AS secondary_text,
 printf('%.8f', 5e-1*primary_score + 5e-1*secondary_score) AS composite FROM scored""",
)
def a13_oof_rows(spark, sf):
    from clipscore.functions.scores import blend

    a, b = F.col("primary_score"), F.col("secondary_score")

    def text(score):
        return sinks.score_text(score, sinks.OOF_DECIMALS)

    return views.scored(spark, sf).select(
        F.concat(F.lit("c"), F.col("clip_id").cast("string")).alias("filename"),
        "label",
        F.col("grp").alias("group"),
        (F.col("clip_id") % 5).cast("int").alias("fold"),
        text(a).alias("primary_text"),
        text(b).alias("secondary_text"),
        text(blend([(0.5, a), (0.5, b)])).alias("composite"),
    )


UTTERANCE = "concat(CASE WHEN clip_id % 43 = 0 THEN 'X_' ELSE 'T_' END, lpad(CAST(clip_id AS VARCHAR(20)), 10, '0'))"
LINE = f"""concat('  ', 'SPK', CAST(clip_id % 9 AS VARCHAR(9)), ' ', {UTTERANCE}, ' F  - - - ', CASE WHEN clip_id % 47 = 0 THEN '' ELSE 'c1 ' END,
 CASE WHEN label = 1 THEN concat('A', CAST(clip_id % 3 AS VARCHAR(9))) ELSE '-' END, ' ',
 CASE WHEN clip_id % 53 = 0 THEN 'odd' WHEN label = 1 THEN 'spoof' ELSE 'bonafide' END, ' -')"""


def protocol(spark, sf):
    lines = views.scored(spark, sf).select("clip_id", F.expr(LINE).alias("value"))
    return Mf.parse_protocol(lines)


@catalog.add(
    "a14_protocol_lines",
    with_(views.SCORED)
    + """, v AS (SELECT CASE WHEN clip_id % 47 = 0 THEN 'needs 10 fields' WHEN clip_id % 43 = 0 THEN 'unsafe utterance id'
 WHEN clip_id % 53 = 0 THEN 'unrecognized key' ELSE 'ok' END AS verdict FROM scored) SELECT verdict, count(*) AS n FROM v GROUP BY verdict""",
)
def a14_protocol_lines(spark, sf):
    verdict = F.coalesce("reason", F.lit("ok")).alias("verdict")
    return protocol(spark, sf).groupBy(verdict).agg(F.count("*").alias("n"))


PROTOCOL_SQL = f"""manifest AS (SELECT concat({UTTERANCE}, '.flac') AS filename, label,
 CASE WHEN label = 0 THEN concat('corpus:real:SPK', CAST(clip_id % 9 AS VARCHAR)) ELSE concat('corpus:spoof:A', CAST(clip_id % 3 AS VARCHAR)) END AS grp
 FROM scored WHERE clip_id % 47 <> 0 AND clip_id % 43 <> 0 AND clip_id % 53 <> 0 AND clip_id % 6 <> 1)"""


def protocol_manifest(spark, sf):
    name = F.concat(F.lit("T_"), F.lpad(F.col("clip_id").cast("string"), 10, "0"), F.lit(".flac"))
    present = views.scored(spark, sf).where("clip_id % 6 <> 1").select(name.alias("filename"))
    return Mf.protocol_manifest(protocol(spark, sf), present, "corpus")


@catalog.add(
    "a14_protocol_manifest",
    with_(views.SCORED, PROTOCOL_SQL) + " SELECT filename, label, grp FROM manifest",
)
def a14_protocol_manifest(spark, sf):
    return protocol_manifest(spark, sf)


@catalog.add(
    "a14_protocol_summary",
    with_(views.SCORED, PROTOCOL_SQL)
    + """ SELECT count(*) AS clips, CAST(sum(1-label) AS BIGINT) AS real, CAST(sum(label) AS BIGINT) AS synthetic,
 count(DISTINCT grp) AS groups, string_agg(DISTINCT CASE WHEN label = 1 THEN split_part(grp, ':', 3) END, ',' ORDER BY CASE WHEN label = 1 THEN split_part(grp, ':', 3) END) AS families FROM manifest""",
)
def a14_protocol_summary(spark, sf):
    return Mf.manifest_summary(protocol_manifest(spark, sf))


MEMBER = """CASE clip_id % 8 WHEN 0 THEN concat('pack/', path) WHEN 1 THEN concat('pack/../', suffix, '.wav')
 WHEN 2 THEN concat('/abs/', suffix, '.wav') WHEN 3 THEN concat('pack/a/b/x', CAST(clip_id AS VARCHAR(20)), '.wav')
 ELSE concat('pack/LJ', lpad(CAST(clip_id % 1000 AS VARCHAR(9)), 3, '0'), '-', lpad(CAST(clip_id % 10000 AS VARCHAR(9)), 4, '0'), '.wav') END"""
BYTES = "CAST(size AS BIGINT) * CASE WHEN clip_id % 9 = 4 THEN 1000000 ELSE 1 END"


@catalog.add(
    "a15_member_rules",
    with_(
        views.CONTAINERS,
        f"m AS (SELECT clip_id, {MEMBER} AS member, {BYTES} AS bytes FROM containers)",
        """p AS (SELECT *, list_concat(CASE WHEN member LIKE '/%' THEN ['/'] ELSE [] END,
 list_filter(string_split(member, '/'), lambda x: x <> '' AND x <> '.')) AS parts FROM m)""",
        """s AS (SELECT clip_id, member, CASE
 WHEN len(list_filter(parts, lambda x: x = '..' OR NOT regexp_full_match(x, '[A-Za-z0-9_.-]+'))) > 0 THEN 'unsafe path'
 WHEN len(parts) <> 2 OR NOT regexp_full_match(parts[-1], 'LJ[0-9]{3}-[0-9]{4}[.]wav') THEN 'ignored'
 WHEN bytes > 30000000 THEN 'too large' WHEN count(*) OVER (PARTITION BY member) > 1 THEN 'duplicate member' ELSE 'accepted' END AS status FROM p)""",
    )
    + " SELECT clip_id, member, status FROM s",
)
def a15_member_rules(spark, sf):
    rows = views.containers(spark, sf).select(
        "clip_id", F.expr(MEMBER).alias("member"), F.expr(BYTES).alias("bytes")
    )
    out = L.check_members(rows, (2,), L.REAL_MEMBER, size="bytes", max_bytes=30_000_000)
    return out.select("clip_id", "member", "status")


@catalog.add(
    "a18_missing_features",
    with_(views.CONTAINERS)
    + """ SELECT suffix, count(*) AS missing FROM containers WHERE clip_id % 7 = 0 OR clip_id % 10 = 1 OR clip_id % 11 = 2 GROUP BY suffix""",
)
def a18_missing_features(spark, sf):
    """Store lacking some clips, holding others at an older size, others from older code.

    Pages may share a URL; a clip's path names its page too, as files of a listing differ by path.
    """
    files = views.containers(spark, sf).select(
        "clip_id",
        F.concat_ws("#", "path", "clip_id").alias("path"),
        "suffix",
        F.coalesce("size", F.lit(0)).alias("length"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modificationTime"),
    )
    old = F.when(F.col("clip_id") % 10 == 1, F.col("length") - 1).otherwise(F.col("length"))
    stored = files.where("clip_id % 7 <> 0").withColumn("length", old)
    kept = F.when(F.col("clip_id") % 11 == 2, store.identity("v0", "base")).otherwise(
        store.identity("v1", "base")
    )
    todo = store.missing_clips(files, stored.withColumn("identity", kept), "v1", "base")
    return todo.groupBy("suffix").agg(F.count("*").alias("missing"))


@catalog.add(
    "a19_spot_check_rows",
    with_(views.SPECTRA)
    + f""", n AS (SELECT clip_id, mag, row_number() OVER (ORDER BY clip_id) - 1 AS pos, count(*) OVER () AS total FROM spectra),
 want AS (SELECT DISTINCT CAST(floor(j*(total-1)/4) AS BIGINT) AS pos FROM (SELECT max(total) AS total FROM n) t, range(0, 5) r(j))
 SELECT n.pos, clip_id, {s6('list_sum(mag)')} AS checksum, true AS same FROM n JOIN want ON n.pos = want.pos""",
)
def a19_spot_check_rows(spark, sf):
    """Five evenly spaced rows of the numbered store, recomputed from the source."""
    from clipscore.functions.vectors import total

    saved = store.number_rows(views.spectra(spark, sf), "clip_id")
    picked = sampling.evenly_spaced(saved, [], ["clip_id"], 5)
    fresh = views.spectra(spark, sf).select("clip_id", F.col("mag").alias("fresh"))
    return picked.join(fresh, "clip_id").select(
        "pos",
        "clip_id",
        r6(total(F.col("mag"))).alias("checksum"),
        F.expr("mag = fresh").alias("same"),
    )


@catalog.add(
    "a20_checksums", "SELECT page_id AS clip_id, sha256(html) AS sha256 FROM pages"
)
def a20_checksums(spark, sf):
    pages = views.table(spark, sf, "pages")
    return pages.select(
        F.col("page_id").alias("clip_id"), F.sha2(F.encode("html", "UTF-8"), 256).alias("sha256")
    )
