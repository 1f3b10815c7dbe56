"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipscore.llm.common import DOCUMENT_COLUMNS, in_arrow

UNKNOWN = "und"
ORDER = 3
_BITS = 21  # of a symbol: any code point, so that three symbols pack into one 64-bit code
_BLOCK_CHARS = 1 << 20
_SCALES = tuple(2.0**-k for k in range(9))


@dataclass(frozen=True)
class Order:
    """One order of one language: sorted packed n-grams with their probabilities, and the sorted histories
    (n-grams without their last symbol) with the weight that each leaves to the order below."""

    gram: np.ndarray
    prob: np.ndarray
    history: np.ndarray
    weight: np.ndarray


@dataclass(frozen=True)
class Model:
    """Per language, log2 probabilities of a symbol after the two before it.

    ``orders[lang]`` are the orders 1 to 3 of a language.  ``kinds`` counts the symbols learnt in any
    language and one for all others; the lowest order rests on equal chances of these.  ``mean``, ``spread``
    and ``noise`` describe the cross-entropy of held-out documents of a language (variance = spread +
    noise / symbols), ``scale`` the certainty of a symbol.
    """

    languages: tuple[str, ...]
    kinds: int
    orders: tuple[tuple[Order, ...], ...]
    mean: np.ndarray
    spread: np.ndarray
    noise: np.ndarray
    scale: float


_letters: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """Symbols of a text in lower case: a letter is its code point, and runs of anything else become one 0, with one at either end."""
    if not _letters:
        _letters.append(np.array([p if chr(p).isalpha() else 0 for p in range(0x110000)], np.uint32))
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros(len(points) + 2, np.uint32)
    out[1:-1] = _letters[0][points]
    return out[np.concatenate([[True], (out[1:] != 0) | (out[:-1] != 0)])]


def codes(syms: np.ndarray, n: int) -> np.ndarray:
    """Packed codes of the n-grams of symbols, one for each position that has one."""
    count = max(0, len(syms) - n + 1)
    out = np.zeros(count, np.int64)
    for i in range(n):
        out = (out << _BITS) | syms[i : i + count]
    return out


def _last(code: np.ndarray, n: int) -> np.ndarray:
    return code & np.int64((1 << (_BITS * n)) - 1)


def _gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n) of trigrams, added up in the map tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                parts = [codes(symbols(batch.column(1)[i].as_py() or ""), ORDER) for i, x in enumerate(langs) if x == lang]
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n.astype("i8"))], ["lang", "code", "n"])

    return in_arrow(docs.select("lang", "text"), run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def kneser_ney(code: np.ndarray, count: np.ndarray, kinds: int) -> tuple[Order, ...]:
    """Interpolated probabilities of all orders from the sorted trigrams of a language and their counts.

    Lower orders count the distinct symbols seen before a gram; each order takes an absolute discount
    n1 / (n1 + 2 n2) off and gives its mass to the order below; the lowest rests on equal chances.
    """
    counts = {ORDER: (code, count)}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = np.unique(_last(counts[n + 1][0], n), return_counts=True)
    orders: list[Order] = []
    for n in range(1, ORDER + 1):
        gram, c = counts[n]
        n1, n2 = int((c == 1).sum()), int((c == 2).sum())
        discount = n1 / (n1 + 2 * n2) if n1 else 0.5
        history, at = np.unique(gram >> _BITS, return_inverse=True)
        total = np.bincount(at, c)
        weight = discount * np.bincount(at) / total
        lower = orders[-1].prob[np.searchsorted(orders[-1].gram, _last(gram, n - 1))] if orders else 1.0 / kinds
        prob = np.maximum(c - discount, 0) / total[at] + weight[at] * lower
        orders.append(Order(gram, prob, history, weight))
    return tuple(orders)


def _fitted(counts: DataFrame, kinds: int) -> DataFrame:
    """One row a language and order, each language fitted by itself; its trigrams are bounded by the sample."""

    def one(table: pa.Table) -> pa.Table:
        code, n = table.column("code").to_numpy(), table.column("n").to_numpy()
        by = np.argsort(code)
        orders = kneser_ney(code[by], n[by], kinds)
        whole, real = pa.list_(pa.int64()), pa.list_(pa.float64())
        return pa.Table.from_arrays(
            [
                pa.array([table.column("lang")[0].as_py()] * ORDER, pa.string()),
                pa.array(range(1, ORDER + 1), pa.int32()),
                pa.array([o.gram for o in orders], whole),
                pa.array([o.prob for o in orders], real),
                pa.array([o.history for o in orders], whole),
                pa.array([o.weight for o in orders], real),
            ],
            ["lang", "n", "gram", "prob", "history", "weight"],
        )

    schema = "lang string, n int, gram array<bigint>, prob array<double>, history array<bigint>, weight array<double>"
    return counts.groupBy("lang").applyInArrow(one, schema)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def log_probabilities(model: Model, lang: int, code: np.ndarray) -> np.ndarray:
    """log2 P(last symbol | first two) of trigram codes in a language, by backing off along the orders."""
    p = np.full(len(code), 1.0 / model.kinds)
    for n, order in enumerate(model.orders[lang], 1):
        gram = _last(code, n)
        at, seen = _find(order.gram, gram)
        h_at, h_seen = _find(order.history, gram >> _BITS)
        p = np.where(seen, order.prob[at], np.where(h_seen, order.weight[h_at], 1.0) * p)
    return np.log2(p)


def _bits(model: Model, texts: list[str], power: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the bits of a symbol, raised to ``power``, over whole texts (a row a language), and their numbers of symbols.

    Each distinct trigram of the block is looked up once; its bits are then spread.
    """
    coded = [codes(symbols(t), ORDER) for t in texts]
    sizes = np.array([len(c) for c in coded])
    sums = np.zeros((len(model.languages), len(texts)))
    if sizes.sum():
        at, distinct = pd.factorize(np.concatenate(coded))
        filled = np.flatnonzero(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes[filled])])[:-1]
        for lang in range(len(model.languages)):
            bits = (-log_probabilities(model, lang, distinct)) ** power
            sums[lang, filled] = np.add.reduceat(bits[at], starts)
    return sums / np.maximum(sizes, 1), sizes


def cross_entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bits per symbol of whole texts (a row a language), and their numbers of symbols, letters or not."""
    return _bits(model, texts)


def training_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` documents of each language (all, where there are fewer), by a hash of doc_id.

    The share to take of each is a literal of one entry a language, as the model has, and the choice a
    filter: nothing is shuffled, no frequent language gathered.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sizes = labelled.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return labelled.select("lang", "text").limit(0)
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, per_language / r["count"])])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(draw < F.coalesce(shares[F.col("lang")], F.lit(0.0))).select("lang", "text")


def fit(labelled: DataFrame, *, per_language: int = 400, least_spread: float = 0.3) -> Model | None:
    """A model of all languages of ``labelled`` (lang, text); None without any.

    Bounds: the sample holds about ``per_language`` documents of each label (whole texts; one in eleven is
    kept for calibration); all their letters are learnt, of any script.  Spark adds the counts up and fits
    each language in a task of its own; the finished arrays, no longer than the sample, reach the driver.
    Languages whose every text is without a letter are not learnt.
    """
    docs = training_sample(labelled, per_language).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(11)))
    counts = _gram_counts(docs.where("part > 0")).persist()
    try:
        kinds = 1 + counts.select(F.col("code").bitwiseAND((1 << _BITS) - 1).alias("symbol")).distinct().count()
        found = _fitted(counts, kinds).toArrow().sort_by([("lang", "ascending"), ("n", "ascending")])
    finally:
        counts.unpersist()
    names = tuple(found.column("lang").to_pylist()[::ORDER])
    if not names:
        return None
    parts = [[x.values.to_numpy() for x in found.column(c)] for c in ("gram", "prob", "history", "weight")]
    orders = [Order(*x) for x in zip(*parts)]
    grouped = tuple(tuple(orders[i : i + ORDER]) for i in range(0, len(orders), ORDER))
    flat = np.zeros(len(names))
    return _calibrated(Model(names, kinds, grouped, flat, flat + 1, flat, 1.0), docs.where("part = 0"), least_spread)


def _calibrated(model: Model, held: DataFrame, least_spread: float) -> Model:
    """Limits and certainty from held-out documents.

    Per language the mean of the cross-entropy, its spread over long documents (at least ``least_spread``
    bits: real texts switch language, quote code or licences) and the variance of a symbol's bits, which is
    the noise of short texts.  The scale is that of ``_SCALES`` with the least logarithmic loss of the true
    labels.  A language without held-out documents takes the bits of equal chances, so nothing of it goes.
    """
    shared = held.sparkSession.sparkContext.broadcast(model)
    names = ["lang", "h", "n", "noise", *[f"loss{i}" for i in range(len(_SCALES))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = {x: i for i, x in enumerate(m.languages)}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            (h, n), (squares, _) = _bits(m, texts), _bits(m, texts, 2)
            keep = np.array([i for i, x in enumerate(langs) if x in place and n[i] > 0], int)
            at = np.array([place[langs[i]] for i in keep], int)
            own, size = h[at, keep], n[keep].astype("f8")
            losses = []
            for scale in _SCALES:
                gap = -scale * size * (h[:, keep] - own)
                losses.append(np.logaddexp2.reduce(gap, axis=0) if len(keep) else own)
            columns = [own, size, squares[at, keep] - own**2, *losses]
            yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in keep], pa.string()), *map(pa.array, columns)], names)

    seen = in_arrow(held.select("lang", "text"), run, ", ".join(["lang string", *[f"{c} double" for c in names[1:]]]))

    def mean(c: str) -> Column:
        return F.sum(F.col(c) * F.col("n")) / F.sum("n")

    losses = [F.sum(c).alias(c) for c in names[4:]]
    stats = seen.groupBy("lang").agg(
        mean("h").alias("mean"), F.var_pop(F.when(F.col("n") >= 200, F.col("h"))).alias("spread"), mean("noise").alias("noise"), *losses
    ).collect()  # one row a language
    by = {r.lang: r for r in stats}
    equal = float(np.log2(model.kinds))
    means = np.array([by[x].mean if x in by else equal for x in model.languages])
    spread = np.array([max((by[x].spread if x in by else None) or 0.0, least_spread**2) for x in model.languages])
    noise = np.array([by[x].noise if x in by else equal**2 for x in model.languages])
    total = [sum(r[c] for r in stats) for c in names[4:]]
    scale = min(zip(total, _SCALES))[1] if stats else _SCALES[2]
    return replace(model, mean=means, spread=spread, noise=noise, scale=scale)


def predict(docs: DataFrame, model: Model | None, *, tolerance: float = 8.0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score, accepted, bits for every whole text.

    lang_pred has the least cross-entropy per symbol (ties: first in order).  ``score`` is its posterior
    chance when every symbol counts ``scale`` as much.  A prediction is accepted while its cross-entropy
    lies at most ``tolerance`` standard deviations above the language's mean for texts of that length.
    Null texts and texts without a letter are ``und``, score 0, not accepted; so is everything without a
    model.  Repeated rows each get their row; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    columns = [*keep] if "text" in keep else [*keep, "text"]
    text_at = columns.index("text")

    def predicted(m: Model | None, texts: list[str]):
        letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        lang, score, accepted, bits = np.array([UNKNOWN] * len(texts), object), np.zeros(len(texts)), np.zeros(len(texts), bool), np.zeros(len(texts))
        if m is not None and letters.any():
            h, n = cross_entropies(m, texts)
            best = h.argmin(axis=0)
            low = h[best, np.arange(len(texts))]
            odds = np.exp2(-m.scale * n * (h - low))
            limit = m.mean[best] + tolerance * np.sqrt(m.spread[best] + m.noise[best] / np.maximum(n, 1))
            lang[letters] = np.array(m.languages, object)[best[letters]]
            score[letters] = (1.0 / odds.sum(axis=0))[letters]
            bits[letters] = low[letters]
            accepted = letters & (low <= limit)
        return lang, score, accepted, bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            start, held, texts = 0, 0, []
            for i in range(batch.num_rows):
                texts.append(batch.column(text_at)[i].as_py() or "")
                held += len(texts[-1])
                if held >= _BLOCK_CHARS or i == batch.num_rows - 1:
                    lang, score, accepted, bits = predicted(m, texts)
                    own = [batch.column(c).slice(start, i + 1 - start) for c in range(len(keep))]
                    yield pa.RecordBatch.from_arrays(
                        [*own, pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(accepted), pa.array(bits)],
                        [*keep, "lang_pred", "score", "accepted", "bits"],
                    )
                    start, held, texts = i + 1, 0, []

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, accepted boolean, bits double"
    return in_arrow(docs.select(*columns), run, schema)


def held_out(column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by five; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted, learnt from the documents that are not held out alone."""
    model = fit(docs.where(~held_out()), **bounds)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def keep_accepted(docs: DataFrame, **bounds) -> DataFrame:
    """The documents whose prediction is accepted, with the columns of documents.

    The model learns from all labelled documents.  A null ``lang`` is filled with the prediction; others stay.
    Null texts, texts without a letter and, where nothing is labelled, all rows go; each repeated row is judged
    alike; an empty table gives an empty one; further columns are left out.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    kept = predict(docs, fit(docs, **bounds), keep=DOCUMENT_COLUMNS).where("accepted")
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*DOCUMENT_COLUMNS)
