"""Deal documents to byte-limited shards by extendible hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipscore.llm.common import cut, text_of

HASH_BITS = 60
ROUND_BITS = 6


def _prefix(hashed, depth):
    """The first ``depth`` bits of the hash, as a number."""
    return F.shiftright(hashed, HASH_BITS - depth) if isinstance(depth, int) else F.expr(f"shiftright({hashed}, {HASH_BITS} - {depth})")


def shard(docs: DataFrame, limit: int) -> DataFrame:
    """One row per document: doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, oversized.

    A bucket is the set of documents whose hash starts with the same bits.  A bucket whose texts take
    more than ``limit`` bytes is split on the next bit, others stay whole; ``shard`` names the bucket by
    its bits (the undivided table: ``root``).  Rounds look at ``ROUND_BITS`` further bits at a time and
    only at documents of buckets that are still too large; sums are formed per deepest prefix in
    the map tasks, and the driver learns one number a round.

    Rows of one doc_id (a null one too) stay together.  A bucket that holds one doc_id alone is not
    split: beyond the limit it is ``oversized``.  Null and empty texts take no bytes; an empty table gives
    an empty one; other columns are not looked at.
    """
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 15), 16, 10)
    pending = docs.select("doc_id", F.octet_length(text_of()).cast("bigint").alias("n_bytes"), hashed.cast("bigint").alias("h"))
    placed, low = None, 0
    pending = cut(pending)
    while True:
        high = min(low + ROUND_BITS, HASH_BITS)
        cells = pending.groupBy(_prefix("h", high).alias("cell")).agg(
            F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"), F.min("h").alias("low_h"), F.max("h").alias("high_h")
        )
        levels = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        nodes = (
            levels.groupBy("depth", F.expr(f"shiftright(cell, {high} - depth)").alias("prefix"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("low_h").alias("low_h"), F.max("high_h").alias("high_h"))
            .withColumn("whole", (F.col("bytes") <= limit) | (F.col("low_h") == F.col("high_h")) | (F.col("depth") == HASH_BITS))
        )
        leaf = F.min(F.when(F.col("whole"), F.struct("depth", "bytes", "docs")))
        chosen = (
            levels.select("cell", "depth", F.expr(f"shiftright(cell, {high} - depth)").alias("prefix"))
            .join(nodes, ["depth", "prefix"])
            .groupBy("cell")
            .agg(leaf.alias("leaf"))
        )
        found = cut(pending.withColumn("cell", _prefix("h", high)).join(chosen, "cell").select("doc_id", "n_bytes", "h", "leaf"))
        done = found.where("leaf IS NOT NULL").select("doc_id", "n_bytes", "h", "leaf.depth", F.col("leaf.bytes").alias("shard_bytes"), F.col("leaf.docs").alias("shard_docs"))
        placed = done if placed is None else placed.unionByName(done)
        pending = found.where("leaf IS NULL").select("doc_id", "n_bytes", "h")
        if high == HASH_BITS or pending.isEmpty():
            break
        low = high
    bits = F.expr(f"lpad(conv(shiftright(h, {HASH_BITS} - depth), 10, 2), depth, '0')")
    return placed.select(
        "doc_id", "n_bytes", F.when(F.col("depth") == 0, "root").otherwise(bits).alias("shard"),
        "depth", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized"),
    )


def shard_sql(limit: int, depths: int = 30) -> str:
    """DuckDB SQL for :func:`shard` where no bucket needs more than ``depths`` bits."""
    return f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
e AS (SELECT *, unnest(range(0, {depths + 1}))::INT AS depth FROM d),
n AS (SELECT depth, h >> ({HASH_BITS} - depth) AS prefix, sum(n_bytes)::BIGINT AS bytes, count(*) AS docs,
      min(h) = max(h) AS alone FROM e GROUP BY 1, 2),
leaf AS (SELECT e.doc_id, e.n_bytes, e.h, min(e.depth) AS depth FROM e JOIN n
         ON e.depth = n.depth AND (e.h >> ({HASH_BITS} - e.depth)) = n.prefix
         WHERE bytes <= {limit} OR alone GROUP BY ALL)
SELECT doc_id, n_bytes, CASE WHEN l.depth = 0 THEN 'root' ELSE
       right(lpad(bin(h), {HASH_BITS}, '0')[1:l.depth], l.depth) END AS shard, l.depth,
       bytes AS shard_bytes, docs AS shard_docs, bytes > {limit} AS oversized
FROM leaf l JOIN n ON l.depth = n.depth AND (l.h >> ({HASH_BITS} - l.depth)) = n.prefix"""
