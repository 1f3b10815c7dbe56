"""Sampling, ranking, split and fold queries (H, J) over the scored manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipscore import views
from clipscore.catalog.common import Catalog, r6, s6, with_
from clipscore.catalog.metrics import LONG, curve_sql, long_scores
from clipscore.operators import comparison, sampling, splits
from clipscore.operators import metrics as M
from clipscore.operators.ordered import ranked

catalog = Catalog()

HASHED = """hashed AS (SELECT *, md5(CAST(clip_id AS VARCHAR)) AS h,
 row_number() OVER (PARTITION BY grp ORDER BY md5(CAST(clip_id AS VARCHAR)), clip_id) AS k FROM scored)"""


@catalog.add(
    "h1_hash_bottom_k",
    with_(views.SCORED, HASHED) + " SELECT grp, clip_id, k FROM hashed WHERE k <= 5",
)
def h1_hash_bottom_k(spark, sf):
    out = sampling.hash_bottom_k(views.scored(spark, sf), "grp", "clip_id", 5)
    return out.select("grp", "clip_id", F.col("rn").cast("long").alias("k"))


@catalog.add(
    "h2_round_robin",
    with_(
        views.SCORED,
        HASHED,
        "placed AS (SELECT *, row_number() OVER (ORDER BY k, grp) AS place FROM hashed WHERE k <= 10)",
    )
    + " SELECT grp, clip_id FROM placed WHERE place <= 100",
)
def h2_round_robin(spark, sf):
    return sampling.round_robin(views.scored(spark, sf), "grp", "clip_id", 10, 100).select(
        "grp", "clip_id"
    )


@catalog.add(
    "h3_balanced_sample",
    with_(
        views.SCORED,
        """r AS (SELECT *, md5(concat('2026:', CAST(clip_id AS VARCHAR))) AS h FROM scored)""",
        """k AS (SELECT *, row_number() OVER (PARTITION BY label, grp ORDER BY h, clip_id) AS k,
 dense_rank() OVER (PARTITION BY label ORDER BY grp) AS gi FROM r)""",
        """g AS (SELECT label, count(DISTINCT grp) AS g FROM scored GROUP BY label)""",
        """p AS (SELECT k.*, CASE WHEN k <= floor(50e0/g) + CASE WHEN gi <= 50 % g THEN 1 ELSE 0 END THEN 0 ELSE 1 END AS leftover
 FROM k JOIN g ON k.label = g.label)""",
        "f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY leftover, h, clip_id) AS place FROM p)",
    )
    + " SELECT label, grp, clip_id FROM f WHERE place <= 50",
)
def h3_balanced_sample(spark, sf):
    out = sampling.balanced_sample(views.scored(spark, sf), "label", "grp", "clip_id", 50, 2026)
    return out.select("label", "grp", "clip_id")


@catalog.add(
    "h4_evenly_spaced",
    with_(
        views.SCORED,
        """n AS (SELECT label, clip_id, row_number() OVER (PARTITION BY label ORDER BY clip_id) - 1 AS i,
 count(*) OVER (PARTITION BY label) AS n FROM scored)""",
        "w AS (SELECT DISTINCT label, CAST(floor(j*(n-1)/19) AS BIGINT) AS i FROM (SELECT DISTINCT label, n FROM n) q, range(0, 20) r(j))",
    )
    + " SELECT n.label, n.clip_id FROM n JOIN w ON n.label = w.label AND n.i = w.i",
)
def h4_evenly_spaced(spark, sf):
    rows = views.scored(spark, sf).select("label", "clip_id")
    return sampling.evenly_spaced(rows, ["label"], ["clip_id"], 20)


@catalog.add(
    "h5_top_contributions",
    with_(
        views.SPECTRA,
        """e AS (SELECT clip_id, CAST(generate_subscripts(mag, 1) - 1 AS INT) AS pos, unnest(mag) AS v FROM spectra)""",
        "c AS (SELECT clip_id, pos, (v - 5e-2) * (pos % 3 - 1) AS c FROM e)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY abs(c) DESC, pos) AS place FROM c WHERE abs(c) > 1e-8)",
    )
    + f""" SELECT clip_id, concat('f', CAST(pos AS VARCHAR)) AS feature, {s6('c')} AS contribution,
 CASE WHEN c > 0 THEN 'synthetic' ELSE 'real' END AS direction FROM r WHERE place <= 8""",
)
def h5_top_contributions(spark, sf):
    names = F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(F.lit("f"), i.cast("string"))
    )
    values = F.transform("mag", lambda v, i: (v - 0.05) * (i % 3 - 1))
    rows = views.spectra(spark, sf).select("clip_id", values.alias("c"), names.alias("n"))
    top = rows.select(
        "clip_id", F.explode(sampling.top_contributions(F.col("c"), F.col("n"))).alias("e")
    )
    return top.select(
        "clip_id",
        "e.feature",
        r6("e.contribution").alias("contribution"),
        F.when(F.col("e.contribution") > 0, "synthetic").otherwise("real").alias("direction"),
    )


FOUR = """four AS (SELECT clip_id, label, corpus, CASE WHEN j = 0 THEN model ELSE concat(model, '_soft') END AS model,
 CAST(CASE model WHEN 'primary' THEN 0 ELSE 2 END + j AS INT) AS pos, round(CASE WHEN j = 0 THEN score ELSE score*score END + (clip_id * (j+3)) % 5 / 5e1, 12) AS score
 FROM long, range(0, 2) r(j))"""


def four_models(spark, sf):
    rows = long_scores(spark, sf).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(1))))
    soft = F.col("j") == 1
    noise = (F.col("clip_id") * (F.col("j") + 3)) % 5 / 50.0
    return rows.select(
        "clip_id",
        "label",
        "corpus",
        (F.when(F.col("model") == "primary", 0).otherwise(2) + F.col("j")).cast("int").alias("pos"),
        F.when(soft, F.concat("model", F.lit("_soft"))).otherwise(F.col("model")).alias("model"),
        F.round(
            F.when(soft, F.col("score") * F.col("score")).otherwise(F.col("score")) + noise, 12
        ).alias("score"),
    )


@catalog.add(
    "h6_best_two_models",
    with_(views.SCORED, LONG, FOUR, curve_sql("corpus, model, pos", "four"))
    + f""" SELECT corpus, model, {s6('cost')} AS min_dcf, place FROM (SELECT *, row_number() OVER
 (PARTITION BY corpus ORDER BY round(cost, 9), pos) AS place FROM best) q WHERE place <= 2""",
)
def h6_best_two_models(spark, sf):
    per = M.min_dcf(four_models(spark, sf), ["corpus", "model", "pos"])
    out = comparison.top_models(per, ["corpus"], 2)
    return out.select(
        "corpus", "model", r6("min_dcf").alias("min_dcf"), F.col("place").cast("long").alias("place")
    )


@catalog.add(
    "h7_path_order",
    with_(views.CONTAINERS)
    + " SELECT clip_id, row_number() OVER (ORDER BY lower(path), path, clip_id) AS ord FROM containers",
)
def h7_path_order(spark, sf):
    rows = views.containers(spark, sf).withColumn("low", F.lower("path"))
    return ranked(rows, [], ["low", "path", "clip_id"], "ord").select("clip_id", "ord")


# -- J: splits and folds -----------------------------------------------------------------------


@catalog.add(
    "j1_clip_split",
    with_(views.SCORED, splits.CLIP_SPLIT_SQL) + " SELECT clip_id, label, side FROM parted",
)
def j1_clip_split(spark, sf):
    out = splits.clip_split(views.scored(spark, sf), "label", "clip_id", 0.2, 42)
    return out.select("clip_id", "label", "side")


GROUP_SPLIT = """gt AS (SELECT grp, sum(1-label) AS real, sum(label) AS spoof FROM scored GROUP BY grp),
facts AS (SELECT greatest(2, CAST(ceil(count(*)*2e-1) AS BIGINT)) AS nt, sum(real) AS r, sum(spoof) AS s FROM gt),
drawn AS (SELECT grp, real, spoof, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(concat(CAST(seed AS VARCHAR), ':', grp)), grp) AS rn
 FROM gt, range(42, 142) q(seed)),
scores AS (SELECT seed, sum(CASE WHEN rn <= nt THEN real ELSE 0 END) AS tr, sum(CASE WHEN rn <= nt THEN spoof ELSE 0 END) AS ts,
 max(r) AS r, max(s) AS s FROM drawn, facts GROUP BY seed),
usable AS (SELECT seed, abs(tr*1e0/r - 2e-1) + abs(ts*1e0/s - 2e-1) AS score FROM scores WHERE tr > 0 AND ts > 0 AND tr < r AND ts < s),
pick AS (SELECT seed FROM usable ORDER BY round(score, 12), seed LIMIT 1)"""


@catalog.add(
    "j2_group_split",
    with_(views.SCORED, GROUP_SPLIT)
    + """ SELECT s.clip_id, s.grp, CASE WHEN d.rn <= nt THEN 'test' ELSE 'train' END AS side
 FROM scored s JOIN drawn d ON s.grp = d.grp JOIN pick p ON d.seed = p.seed, facts""",
)
def j2_group_split(spark, sf):
    out = splits.group_split(views.scored(spark, sf), "label", "grp", 0.2, 42)
    return out.select("clip_id", "grp", "side")


@catalog.add(
    "j2_group_split_scores",
    with_(views.SCORED, GROUP_SPLIT) + f" SELECT seed, {s6('score')} AS score FROM usable",
)
def j2_group_split_scores(spark, sf):
    *_, scores = splits.group_split_scores(views.scored(spark, sf), "label", "grp", 0.2, 42)
    return scores.select(F.col("seed").cast("long").alias("seed"), r6("score").alias("score"))


def pack_sql(sizes: str, folds: str, name: str = "pack") -> str:
    """Sequential greedy packing as a recursive query over ``sizes`` (key, grp, n, i)."""
    zeros = f"list_transform(range(0, {folds}), lambda z: CAST(0 AS BIGINT))"
    return f"""{name}(key, i, load, grp, n, fold) AS (SELECT DISTINCT key, CAST(0 AS BIGINT), {zeros}, CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(-1 AS INT) FROM {sizes}
 UNION ALL SELECT p.key, s.i, list_transform(p.load, lambda x, k: CASE WHEN k = list_position(p.load, list_min(p.load)) THEN x + s.n ELSE x END),
 s.grp, s.n, CAST(list_position(p.load, list_min(p.load)) - 1 AS INT) FROM {name} p JOIN {sizes} s ON s.key = p.key AND s.i = p.i + 1)"""


def greedy_sql(where: str, key: str, folds: int, order: str) -> str:
    sizes = f"""sizes AS (SELECT {key} AS key, grp, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {order}) AS i
 FROM scored {where} GROUP BY {key}, grp)"""
    return sizes + ",\n" + pack_sql("sizes", str(folds))


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


@catalog.add(
    "j3_greedy_real_folds",
    recursive(views.SCORED, greedy_sql("WHERE label = 0", "label", 4, "grp"))
    + " SELECT grp, n, fold FROM pack WHERE i > 0",
)
def j3_greedy_real_folds(spark, sf):
    real = views.scored(spark, sf).where("label = 0")
    return splits.greedy_folds(splits.group_sizes(real, [], "grp"), [], "grp", 4)


@catalog.add(
    "j4_seeded_real_folds",
    recursive(
        views.SCORED, greedy_sql("WHERE label = 0", "label", 4, "md5(concat('17:', grp)), grp")
    )
    + " SELECT grp, n, fold FROM pack WHERE i > 0",
)
def j4_seeded_real_folds(spark, sf):
    real = splits.group_sizes(views.scored(spark, sf).where("label = 0"), [], "grp")
    real = real.withColumn("t", sampling.seeded_hash(17, F.col("grp")))
    return splits.greedy_folds(real, [], "grp", 4, "t")


@catalog.add(
    "j5_label_folds",
    recursive(views.SCORED, greedy_sql("", "label", 5, "grp"))
    + " SELECT key AS label, grp, n, fold FROM pack WHERE i > 0",
)
def j5_label_folds(spark, sf):
    sizes = splits.group_sizes(views.scored(spark, sf), ["label"], "grp")
    return splits.greedy_folds(sizes, ["label"], "grp", 5)


@catalog.add(
    "j6_generator_paired_folds",
    with_(
        views.SCORED,
        "gen AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS g FROM (SELECT DISTINCT grp FROM scored WHERE label = 1) q)",
    )
    + " SELECT CAST(p AS INT) AS partition, grp, CAST((i - p + 3*g) % g AS INT) AS fold FROM gen, range(0, 3) r(p)",
)
def j6_generator_paired_folds(spark, sf):
    out = splits.partition_folds(views.scored(spark, sf), "label", "grp", 3)
    return out.where("label = 1").select("partition", "grp", "fold")


PAIRED = (
    """gen AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS i FROM (SELECT DISTINCT grp FROM scored WHERE label = 1) q)""",
    """rs AS (SELECT p AS key, grp, n, row_number() OVER (PARTITION BY p ORDER BY n DESC,
 CASE p WHEN 0 THEN grp WHEN 1 THEN md5(concat('17:', grp)) ELSE md5(concat('29:', grp)) END, grp) AS i
 FROM (SELECT grp, count(*) AS n FROM scored WHERE label = 0 GROUP BY grp) q, range(0, 3) r(p))""",
    pack_sql("rs", "(SELECT count(*) FROM gen)"),
    """folds AS (SELECT CAST(key AS INT) AS partition, grp, fold FROM pack WHERE i > 0 UNION ALL
 SELECT CAST(p AS INT), grp, CAST((i - p + 3*(SELECT count(*) FROM gen)) % (SELECT count(*) FROM gen) AS INT) FROM gen, range(0, 3) r(p))""",
)


@catalog.add(
    "j6_paired_fold_sizes",
    recursive(views.SCORED, *PAIRED)
    + " SELECT partition, fold, label, count(*) AS n FROM scored s JOIN folds f ON s.grp = f.grp GROUP BY partition, fold, label",
)
def j6_paired_fold_sizes(spark, sf):
    """Rows per partition, fold and class; every row sits in exactly one fold of a partition."""
    rows = views.scored(spark, sf)
    folds = splits.partition_folds(rows, "label", "grp", 3)
    joined = rows.join(folds, ["label", "grp"])
    return joined.groupBy("partition", "fold", "label").agg(F.count("*").alias("n"))


def mixed(spark, sf):
    """Labelled clips whose groups (source and language) hold both classes."""
    docs = views.table(spark, sf, "documents").select("doc_id", "source", "lang")
    grp = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    labels = views.table(spark, sf, "labels").join(docs, "doc_id")
    return labels.select(F.col("doc_id").alias("clip_id"), (1 - F.col("quality")).cast("int").alias("label"), grp.alias("grp"))


MIXED = """mixed AS (SELECT l.doc_id AS clip_id, CAST(1 - l.quality AS INT) AS label, concat(coalesce(d.source, ''), '/', coalesce(d.lang, '')) AS grp
FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def counts_sql(rows: str, name: str, key: str, tie: str, source: str | None = None) -> str:
    """Groups in the order of the class-share walk: (key, grp, r, s, i)."""
    source = source or f"(SELECT {key} AS key, grp, count(*) FILTER (label = 0) AS r, count(*) FILTER (label = 1) AS s FROM {rows} GROUP BY {key}, grp)"
    return f"""{name} AS (SELECT key, grp, r, s, sum(r) OVER (PARTITION BY key) AS tr, sum(s) OVER (PARTITION BY key) AS ts,
 row_number() OVER (PARTITION BY key ORDER BY abs(r - s) DESC, r + s DESC, r DESC, {tie}, grp) AS i FROM {source} q)"""


def share_sql(counts: str, folds: int, name: str) -> str:
    """Sequential walk over ``counts`` as a recursive query: every fold is tried for every group."""
    zeros = f"list_transform(range(0, {folds}), lambda z: CAST(0 AS BIGINT))"
    share = "list_aggregate(list_transform(p.l{c}, lambda x, k: (x + CASE WHEN k = f + 1 THEN s.{c} ELSE 0 END)*1e0/greatest(s.t{c}, 1)), 'stddev_pop')"
    spread = f"round(({share.format(c='r')} + {share.format(c='s')})/2e0, 12)"
    tried = f"list_sort(list_transform(range(0, {folds}), lambda f: [{spread}, CAST(p.lr[f + 1] + p.ls[f + 1] AS DOUBLE), CAST(f AS DOUBLE)]))[1][3]"
    return f"""{name}(key, i, lr, ls, grp, n, fold) AS (SELECT DISTINCT key, CAST(0 AS BIGINT), {zeros}, {zeros}, CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(-1 AS INT) FROM {counts}
 UNION ALL SELECT key, i, list_transform(lr, lambda x, k: CASE WHEN k = f + 1 THEN x + r ELSE x END), list_transform(ls, lambda x, k: CASE WHEN k = f + 1 THEN x + s ELSE x END),
 grp, CAST(r + s AS BIGINT), f FROM (SELECT p.key, s.i, p.lr, p.ls, s.grp, s.r, s.s, CAST({tried} AS INT) AS f FROM {name} p JOIN {counts} s ON s.key = p.key AND s.i = p.i + 1) w)"""


@catalog.add(
    "j7_stratified_group_folds",
    recursive(MIXED, counts_sql("mixed", "counts", "CAST(0 AS INT)", "md5(concat('2026:', grp))"), share_sql("counts", 5, "walk"))
    + " SELECT grp, n, fold FROM walk WHERE i > 0",
)
def j7_stratified_group_folds(spark, sf):
    return splits.stratified_group_folds(mixed(spark, sf), "label", "grp", 5, 2026)


@catalog.add(
    "j7_pure_group_folds",
    recursive(views.SCORED, counts_sql("scored", "counts", "CAST(0 AS INT)", "md5(concat('42:', grp))"), share_sql("counts", 5, "walk"))
    + " SELECT grp, n, fold FROM walk WHERE i > 0",
)
def j7_pure_group_folds(spark, sf):
    """Groups of one class each."""
    return splits.stratified_group_folds(views.scored(spark, sf), "label", "grp", 5, 42)


@catalog.add(
    "j8_group_holdouts",
    with_(
        views.SCORED,
        """gt AS (SELECT grp, sum(1-label) AS real, sum(label) AS spoof FROM scored GROUP BY grp)""",
        """drawn AS (SELECT seed, grp, real, spoof, row_number() OVER (PARTITION BY seed ORDER BY md5(concat(CAST(seed AS VARCHAR), ':', grp)), grp)
 <= (SELECT CAST(ceil(count(*)*25e-2) AS BIGINT) FROM gt) AS held FROM gt, range(1, 6) r(seed))""",
        """ok AS (SELECT seed FROM drawn GROUP BY seed HAVING sum(CASE WHEN held THEN real ELSE 0 END) > 0 AND sum(CASE WHEN held THEN spoof ELSE 0 END) > 0
 AND sum(CASE WHEN held THEN 0 ELSE real END) > 0 AND sum(CASE WHEN held THEN 0 ELSE spoof END) > 0)""",
    )
    + " SELECT CAST(d.seed AS INT) AS seed, grp, held FROM drawn d JOIN ok ON d.seed = ok.seed",
)
def j8_group_holdouts(spark, sf):
    return splits.group_holdouts(views.scored(spark, sf), "label", "grp", 0.25, [1, 2, 3, 4, 5])


NESTED = (
    counts_sql("mixed", "counts", "CAST(0 AS INT)", "md5(concat('42:', grp))"),
    share_sql("counts", 5, "walk"),
    counts_sql("", "inner_counts", "", "md5(concat(CAST(key + 43 AS VARCHAR), ':', grp))",
               "(SELECT o AS key, c.grp, c.r, c.s FROM walk w JOIN counts c ON w.grp = c.grp, range(0, 5) r(o) WHERE w.i > 0 AND w.fold <> o)"),
    share_sql("inner_counts", 3, "nested"),
)


@catalog.add(
    "j9_nested_folds",
    recursive(MIXED, *NESTED) + ' SELECT CAST(key AS INT) AS "outer", fold AS "inner", grp FROM nested WHERE i > 0',
)
def j9_nested_folds(spark, sf):
    return splits.nested_folds(mixed(spark, sf), "label", "grp", 5, 3, 42)


@catalog.add(
    "j10_completeness",
    with_(views.SCORED)
    + """ SELECT clip_id, 'primary' AS model, CASE WHEN clip_id % 17 = 1 THEN 2 ELSE 1 END AS rows,
 CASE WHEN clip_id % 17 = 1 THEN 2 ELSE 0 END - CASE WHEN clip_id % 17 = 1 AND clip_id % 13 = 2 THEN 2 ELSE 0 END AS finite
 FROM scored WHERE clip_id % 19 <> 3 AND (clip_id % 17 = 1 OR clip_id % 13 = 2)
 UNION ALL SELECT clip_id, NULL, 0, 0 FROM scored WHERE clip_id % 19 = 3""",
)
def j10_completeness(spark, sf):
    """Planted faults: repeated, NaN and absent out-of-fold scores of one model."""
    rows = long_scores(spark, sf).select("clip_id", "model", "score")
    hit = F.col("model") == "primary"
    rows = rows.where(~(hit & (F.col("clip_id") % 19 == 3)))
    bad = hit & (F.col("clip_id") % 13 == 2)
    rows = rows.withColumn("score", F.when(bad, float("nan")).otherwise(F.col("score")))
    rows = rows.unionByName(rows.where(hit & (F.col("clip_id") % 17 == 1)))
    clips = views.scored(spark, sf).select("clip_id")
    out = splits.completeness(rows, ["model"], clips, long_scores(spark, sf).select("model"))
    return out.select(
        "clip_id", "model", F.col("rows").cast("int").alias("rows"), F.col("finite").cast("int").alias("finite")
    )


@catalog.add(
    "j11_corpus_expansion",
    recursive(
        views.SCORED,
        counts_sql("scored", "counts", "CAST(0 AS INT)", "md5(concat('42:', grp))"),
        share_sql("counts", 5, "walk"),
        "keep AS (SELECT s.* FROM scored s JOIN walk p ON s.grp = p.grp WHERE p.i > 0 AND p.fold <> 0)",
    )
    + """ SELECT training, label, count(*) AS n, count(DISTINCT grp) AS groups FROM (
 SELECT 'original' AS training, label, grp FROM keep WHERE clip_id % 2 = 0
 UNION ALL SELECT 'speakers', label, grp FROM keep WHERE clip_id % 2 = 0 OR grp LIKE 'real:%'
 UNION ALL SELECT 'expanded', label, grp FROM keep) q GROUP BY training, label""",
)
def j11_corpus_expansion(spark, sf):
    """Training sizes of three corpora for the same held-out fold groups."""
    from clipscore.operators import joins

    rows = views.scored(spark, sf)
    folds = splits.stratified_group_folds(rows, "label", "grp", 5, 42).select("grp", "fold")
    held = folds.where("fold = 0").select("grp")
    old, new = rows.where("clip_id % 2 = 0"), rows.where("clip_id % 2 = 1")
    corpora = {
        "original": old.join(held, "grp", "left_anti"),
        "speakers": joins.expanded_training(old, new, held, "grp", "real:").drop("corpus"),
        "expanded": rows.join(held, "grp", "left_anti"),
    }
    parts = [
        df.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("groups"))
        .select(F.lit(name).alias("training"), "label", "n", "groups")
        for name, df in corpora.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
