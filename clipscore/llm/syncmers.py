"""Document fingerprints from closed syncmers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clipscore.llm.common import let, text_of

# A token is a run of up to twelve characters that are not white space, or one character of a script
# written without spaces.
TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[^\x20\x09-\x0D\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]{1,12}"
K, S = 6, 2  # tokens of a k-mer and of its inner substrings
ANCHOR_BITS = 24
BUCKET_ROWS = 4096


def anchors(text: Column) -> Column:
    """Hashes of the closed syncmers of a text, in order (array<int>).

    A k-mer of tokens is chosen when the least hash among its s-mers is that of its first or last one
    (equal hashes count as least): the choice depends on the k-mer alone, so unchanged stretches of two texts give
    the same anchors.  A text without a chosen k-mer has one anchor for all its tokens; one without
    tokens has none.
    """
    window = K - S + 1  # s-mers of a k-mer

    def from_hashes(h: Column) -> Column:
        kmers = F.size(h) - K + 1

        def chosen(s: Column) -> Column:
            def by_minimum(m: Column) -> Column:
                # m[i] is the least of s[i] .. s[i + 3]; one more comparison covers the five s-mers of a k-mer.
                least = lambda i: F.least(m[i], m[i + 1])
                edge = lambda i: (s[i] == least(i)) | (s[i + window - 1] == least(i))
                return F.filter(F.sequence(F.lit(0), kmers - 1), edge)

            pairs = F.transform(F.slice(s, 1, F.size(s) - 1), lambda x, i: F.least(x, s[i + 1]))
            fours = let(pairs, lambda p: F.transform(F.slice(p, 1, F.size(p) - 2), lambda x, i: F.least(x, p[i + 2])))
            return let(fours, by_minimum)

        smers = F.transform(F.slice(h, 1, F.size(h) - S + 1), lambda x, i: F.xxhash64(x, h[i + 1]))
        picked = F.when(kmers >= 1, let(smers, chosen)).otherwise(F.array().cast("array<int>"))
        short = lambda part: F.xxhash64(part).bitwiseAND(F.lit((1 << ANCHOR_BITS) - 1)).cast("int")
        listed = let(picked, lambda at: F.when(F.size(at) > 0, F.transform(at, lambda i: short(F.slice(h, i + 1, K)))).otherwise(F.array(short(h))))
        return F.when(F.size(h) == 0, F.array().cast("array<int>")).otherwise(listed)

    return let(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w)), from_hashes)


def fingerprint(listed: Column) -> Column:
    """Six hexadecimal digits an anchor, in order."""
    return F.array_join(F.transform(listed, lambda a: F.lower(F.lpad(F.hex(a), ANCHOR_BITS // 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared anchors over all (Dice): 1 for equal sets, two empty ones too."""

    def of(sets: Column) -> Column:
        total = F.size(sets["a"]) + F.size(sets["b"])
        return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(sets["a"], sets["b"])) / total)

    return let(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), of)


def _splitters(docs: DataFrame) -> tuple[list[int], int | None, bool]:
    """doc_ids that start buckets, the least doc_id, whether any is null.

    One bucket for each ``BUCKET_ROWS`` rows, but at least one and at most sixteen a shuffle partition: the
    list is bounded by the session's setting, not by the data.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, known, least = docs.select(F.count("*"), F.count("doc_id"), F.min("doc_id")).first()
    buckets = min(n, max(partitions, min(16 * partitions, n // BUCKET_ROWS)))
    if buckets < 2 or least is None:
        return [], least, n > known
    at = [i / buckets for i in range(1, buckets)]
    found = docs.select(F.percentile_approx("doc_id", at, 20 * buckets)).first()[0]
    return sorted({int(x) for x in found} - {least}), least, n > known


def _bucket(splitters: list[int], value: Column) -> Column:
    """How many splitters are at most ``value``, by way of about the square root of their number."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    rows = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    below = lambda items: F.size(F.filter(items, lambda s: s <= value))
    coarse = below(F.array(*[F.lit(r[0]) for r in rows]))
    fine = F.array(*[F.array(*map(F.lit, r)) for r in rows])
    return let(coarse, lambda c: F.when(c == 0, 0).otherwise((c - 1) * step + below(fine[F.greatest(c - 1, F.lit(0))])))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with ``next_<column>`` of the row after it by (doc_id, text), nulls first; the last gets the first.

    Rows go once to ranges of doc_id; the row that starts a range also goes to the range before (the very first
    one to the last), so a window within the range sees every neighbour.
    """
    splitters, least, has_null = _splitters(docs)
    last = len(splitters)
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(_bucket(splitters, F.col("doc_id")))
    starts = F.col("doc_id").isin(splitters) if 0 < last <= 64 else F.lit(last > 0)
    if last > 64:  # membership through the bucket number, not a long list
        firsts = F.array(*map(F.lit, splitters))
        starts = (own > 0) & (firsts[F.greatest(own - 1, F.lit(0))] == F.col("doc_id"))
    very_first = F.col("doc_id").isNull() if has_null else F.col("doc_id") == F.lit(least)
    place = lambda bucket, rank: F.struct(bucket.cast("int").alias("bucket"), F.lit(rank).alias("rank"))
    nowhere = F.array().cast("array<struct<bucket:int,rank:int>>")
    places = F.concat(
        F.array(place(own, 0)),
        F.when(starts & (own > 0), F.array(place(own - 1, 1))).otherwise(nowhere),
        F.when(very_first, F.array(place(F.lit(last), 1))).otherwise(nowhere),
    )
    dealt = docs.select("*", F.inline(places))
    order = W.partitionBy("bucket").orderBy("rank", F.col("doc_id").asc_nulls_first(), "text")
    ahead = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return ahead.where("rank = 0").drop("bucket", "rank")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per document.

    The edited text has the last half of the code points (rounded down) replaced by the first as many, or
    all, of the next document's; next is by doc_id, then text, and the first after the last, so a lone
    document is its own next.  Null texts are empty; an empty table gives an empty one; other columns
    are not looked at.
    """
    texts = docs.select("doc_id", text_of().alias("text"))
    listed = with_next(texts.withColumn("anchors", anchors(F.col("text"))), ["text", "anchors"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    ahead = listed.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "anchors", "next_anchors", edited.alias("edited"))
    done = ahead.withColumn("edited_anchors", anchors(F.col("edited")))
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
