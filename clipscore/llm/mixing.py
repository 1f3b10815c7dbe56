"""Mix sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipscore.llm.common import DOCUMENT_COLUMNS, let, text_of

OTHER = "\x00other"
PART = 500.0  # largest mean drawn at once where sources weigh the same
BROADCAST_SOURCES = 10_000
_DIGITS = 13  # hexadecimal digits of a uniform draw: 52 bits, exact in a double


def _uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) else p for p in parts]))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("bigint") / F.lit(float(16**_DIGITS))


def _group(weights: Mapping[str, float]) -> Column:
    """The source where it has a weight of its own; every other source, null too, is one group."""
    return F.when(F.col("source").isin(*weights), F.col("source")).otherwise(OTHER) if weights else F.lit(OTHER)


def poisson_cdf(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to where nothing is left in a double; logarithms keep large means finite."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    empty = F.struct((-mean).alias("log_p"), F.exp(-mean).alias("total"), F.array(F.exp(-mean)).alias("cdf"))

    def step(state, k):
        log_p = state["log_p"] + F.log(mean) - F.log(k.cast("double"))
        total = state["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(state["cdf"], F.array(total)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), empty, step, lambda s: s["cdf"])


def repetition_rates(docs: DataFrame, weights: Mapping[str, float], other: float, epochs: float) -> DataFrame:
    """(grp, rate, cdf): at most ``len(weights) + 1`` rows whatever the data, so it may be broadcast.

    A group's rate is its share of the weights times ``epochs`` times all characters, over its own
    characters; a group without characters, or with weight zero, has rate zero.
    """
    share = F.create_map(*[F.lit(x) for k, v in {**weights, OTHER: other}.items() for x in (k, float(v))])
    total_weight = float(sum(weights.values()) + other)
    sizes = docs.groupBy(_group(weights).alias("grp")).agg(F.sum(F.length(text_of())).cast("double").alias("chars"))
    gathered = sizes.agg(F.sum("chars").alias("whole"), F.collect_list(F.struct("grp", "chars")).alias("groups"))
    rate = F.when(F.col("chars") > 0, share[F.col("grp")] / total_weight * epochs * F.col("whole") / F.col("chars")).otherwise(0.0)
    return (
        gathered.select("whole", F.inline("groups"))
        .select("grp", rate.alias("rate"))
        .where("rate > 0")
        .select("grp", "rate", poisson_cdf(F.col("rate")).alias("cdf"))
    )


def _dealt(drawn: DataFrame, seed: int) -> DataFrame:
    """Every row ``copies`` times, dealt out and sorted by a hash of (seed, doc_id, copy)."""
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|deal"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy"))), 1, 15), 16, 10)
    return (
        drawn.where("copies > 0")
        .select(*DOCUMENT_COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .withColumn("mix_key", key.cast("bigint"))
        .repartition("mix_key")
        .sortWithinPartitions("mix_key")
    )


def mix_equally(docs: DataFrame, *, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """As :func:`mix`, with the same weight for every source found that has characters, null being one.

    The sources stay a table; the driver gets their number and the characters of all.  A mean above
    ``PART`` is drawn as a sum of Poisson numbers of equal means, which has the same distribution, so that
    a rare source costs time in proportion to its copies.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    sizes = docs.groupBy("source").agg(F.sum(F.length(text_of())).cast("double").alias("chars")).where("chars > 0")
    n, whole = sizes.agg(F.count("*"), F.sum("chars")).first()
    rate = F.lit(epochs * (whole or 0.0) / max(n, 1)) / F.col("chars")
    parts = F.ceil(F.col("rate") / PART).cast("int")
    rates = sizes.select(F.col("source").alias("grp"), rate.alias("rate")).where("rate > 0").withColumn("parts", parts).select("grp", "parts", poisson_cdf(F.col("rate") / F.col("parts")).alias("cdf"))
    drawn = docs.join(F.broadcast(rates) if n <= BROADCAST_SOURCES else rates, docs["source"].eqNullSafe(rates["grp"]))

    def inverted(*parts: Column | str) -> Column:
        return let(_uniform(F.lit(str(seed)), "doc_id", *parts), lambda u: F.size(F.filter("cdf", lambda c: c <= u)))

    sums = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda total, j: total + inverted(j.cast("string")))
    return _dealt(drawn.withColumn("copies", F.when(F.col("parts") == 1, inverted()).otherwise(sums)), seed)


def mix(docs: DataFrame, weights: Mapping[str, float], *, other: float = 0.0, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """Each document repeated a Poisson number of times whose mean is its source's target repetition rate.

    Rates are such that the expected characters of the result are ``epochs`` times the input's, dealt
    to the sources by ``weights`` (``other``: all unlisted sources and null together).  A document's
    draw inverts the Poisson distribution at a hash of (seed, doc_id): it does not depend on order or
    partitions.  The result is dealt out and sorted by a hash of (seed, doc_id, copy).

    Columns: those of documents, ``copy`` (from 1), ``mix_key``.  Other columns of the input are left
    out.  Null and repeated doc_ids draw the same number for each of their rows; null and empty texts
    count no characters but are repeated like any text of their source; an empty table gives an empty one.
    """
    if other < 0 or any(v < 0 for v in weights.values()) or not sum(weights.values()) + other > 0:
        raise ValueError("weights must not be negative, and not all zero")
    docs = docs.select(*DOCUMENT_COLUMNS)
    rates = repetition_rates(docs, weights, other, epochs)
    drawn = docs.withColumn("grp", _group(weights)).join(F.broadcast(rates), "grp")
    copies = F.size(F.filter("cdf", lambda c: c <= _uniform(F.lit(str(seed)), "doc_id")))
    return _dealt(drawn.withColumn("copies", copies), seed)


def mix_sql(weights: Mapping[str, float], *, other: float = 0.0, epochs: float = 1.0, seed: int = 42, docs: str = "documents") -> str:
    """DuckDB SQL for the rows of :func:`mix`."""
    listed = ", ".join(f"('{k}', {float(v)!r})" for k, v in {**weights, OTHER: other}.items()).replace(OTHER, "other group")
    names = ", ".join(f"'{k}'" for k in weights) or "NULL"
    grp = f"CASE WHEN source IN ({names}) THEN source ELSE 'other group' END"
    total = float(sum(weights.values()) + other)
    draw = f"(('0x' || substr(md5(concat_ws('|', '{seed}', coalesce(doc_id::VARCHAR, 'null'))), 1, {_DIGITS}))::BIGINT / {float(16**_DIGITS)!r})"
    key = f"('0x' || substr(md5(concat_ws('|', '{seed}|deal', coalesce(doc_id::VARCHAR, 'null'), copy::VARCHAR)), 1, 15))::BIGINT"
    return f"""
WITH weights(grp, weight) AS (VALUES {listed}),
sizes AS (SELECT {grp} AS grp, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM {docs} GROUP BY 1),
rates AS (SELECT grp, weight / {total!r} * {epochs!r} * (SELECT sum(chars) FROM sizes) / chars AS rate
          FROM sizes JOIN weights USING (grp) WHERE chars > 0 AND weight > 0),
steps AS (SELECT grp, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::INT + 1)) AS k FROM rates),
masses AS (SELECT grp, k, exp(-rate + sum(CASE WHEN k = 0 THEN 0e0 ELSE ln(rate) - ln(k) END)
           OVER (PARTITION BY grp ORDER BY k)) AS p FROM steps),
cdf AS (SELECT grp, list(c ORDER BY k) AS cdf FROM
        (SELECT grp, k, sum(p) OVER (PARTITION BY grp ORDER BY k) AS c FROM masses) GROUP BY grp),
drawn AS (SELECT d.*, len(list_filter(cdf, lambda c: c <= {draw}))::INT AS copies
          FROM (SELECT *, {grp} AS grp FROM {docs}) d JOIN cdf USING (grp)),
dealt AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INT AS copy FROM drawn)
SELECT doc_id, text, lang, source, n_chars, copy, {key} AS mix_key FROM dealt"""
