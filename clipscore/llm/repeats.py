"""Windows of a fixed number of symbols that occur before: the distributed part of both substring removals.

A window's anchor is its least gram (the leftmost of equals), by a hash.  Equal windows have equal anchors at equal
offsets, and successive windows mostly share one, so a text is a sequence of runs of windows with one anchor.
A run is named by its anchor's hash and the hash of all it covers.  One shuffle by anchor settles runs that
are equal as a whole: all but the first are repeats.  Only runs that differ from others of their anchor,
around edits and the ends of shared passages, are compared window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clipscore.llm.common import cut, in_arrow, text_of

BASE = 0x9E3779B97F4A7C15 | 1
BASE_2 = 0xD1B54A32D192ED03
POSITION_BITS = 21
BLOCK = 1 << 18  # symbols looked at together
HOT = 4096  # runs of one anchor that are compared in one go; beyond, windows are dealt out by their own hash

Resolver = Callable[["Candidates"], np.ndarray]


@dataclass(frozen=True)
class Symbols:
    """How a text becomes symbols: ``split`` gives their hashes (uint64); a run's symbols travel as they are in
    ``raw`` (a fixed number of bytes each)."""

    window: int
    gram: int
    split: Callable[[str], np.ndarray]
    raw: Callable[[str], np.ndarray]
    same_document: bool  # whether an earlier start in the same document counts


@dataclass(frozen=True)
class Candidates:
    """Windows to compare: raw symbols of all runs in one buffer, where each window starts, and its bucket (equal
    windows are in one bucket)."""

    raw: np.ndarray
    start: np.ndarray
    bucket: np.ndarray
    window: int


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    if base not in _powers or len(_powers[base][0]) < n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(max(n, BLOCK) + 1024, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers[base] = (both[0], both[1])
    return _powers[base]


class Prefixes:
    """Prefix polynomial hashes: the hash of any stretch from two of them."""

    def __init__(self, values: np.ndarray, base: int = BASE) -> None:
        up, self.down = _powers_of(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchored_runs(values: np.ndarray, bounds: np.ndarray, s: Symbols):
    """Runs of a block: first window, number of windows, offset of the anchor, anchor hash, content hash.

    ``bounds`` are the documents' ends, with a zero before; windows lie within one document.
    """
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    if len(values) < s.window:
        return none
    prefixes = Prefixes(values)
    whole = prefixes.sums[s.gram :] - prefixes.sums[: -s.gram]
    gram = mix(whole * prefixes.down[: len(whole)])
    place = np.uint64((1 << POSITION_BITS) - 1)
    least = _sliding_least((gram & ~place) | np.arange(len(gram), dtype=np.uint64), s.window - s.gram + 1)
    starts, ends = bounds[:-1], bounds[1:]
    long = ends - starts >= s.window
    edges = np.zeros(len(values) + 2, np.int32)
    np.add.at(edges, starts[long], 1)
    np.add.at(edges, ends[long] - s.window + 1, -1)
    at = np.flatnonzero(np.cumsum(edges[: len(least)]) > 0)
    if not len(at):
        return none
    anchor = (least[at] & place).astype(np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(fresh)
    begin, count = at[first], np.diff(np.append(first, len(at)))
    anchor = anchor[first]
    offset = anchor - begin
    form = mix((count.astype(np.uint64) << np.uint64(32)) | offset.astype(np.uint64))
    content = mix(prefixes.of(begin, count + s.window - 1) ^ form)
    return begin, count, offset, gram[anchor], content


def _settle(h, c, dk, pos, same_document: bool) -> tuple[np.ndarray, np.ndarray]:
    """Within a block: which runs repeat an earlier one, and which go on to the shuffle."""
    order = np.lexsort((pos, dk, c, h))
    h, c, dk, pos = h[order], c[order], dk[order], pos[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
    later = dk > dk[first]
    if same_document:
        later |= (dk == dk[first]) & (pos > pos[first])
    again = np.zeros(len(h), bool)
    again[1:] = ~fresh[1:] & (dk[1:] == dk[:-1]) & (pos[1:] == pos[:-1])  # a repeated row
    repeat, go = np.zeros(len(h), bool), np.zeros(len(h), bool)
    repeat[order], go[order] = later & ~again, ~later & ~again
    return repeat, go


RUNS = "h bigint, c bigint, dk bigint, pos bigint, n int, off int"
_SETTLED = -1


def _runs(keyed: DataFrame, s: Symbols) -> DataFrame:
    """Runs to compare (off: the anchor's offset) and stretches of windows already known as repeats (off -1)."""

    def block(values, dk, tk, shift) -> pa.RecordBatch:
        bounds = np.concatenate([[0], np.cumsum([len(v) for v in values])])
        begin, n, off, h, c = anchored_runs(np.concatenate(values), bounds, s)
        doc = np.searchsorted(bounds, begin, side="right") - 1
        dk, tk, shift = np.array(dk, np.int64)[doc], np.array(tk, np.int64)[doc], np.array(shift, np.int64)[doc]
        pos = (tk << 32) + begin - bounds[doc] + shift
        h, c = h.view(np.int64), c.view(np.int64)
        repeat, go = _settle(h, c, dk, pos, s.same_document)
        # Settled stretches that follow one another become one.
        r = np.flatnonzero(repeat)
        r = r[np.lexsort((pos[r], dk[r]))]
        joined = np.zeros(len(r), bool)
        joined[1:] = (dk[r[1:]] == dk[r[:-1]]) & (pos[r[1:]] == pos[r[:-1]] + n[r[:-1]])
        heads = np.flatnonzero(~joined)
        total = np.add.reduceat(n[r], heads) if len(heads) else np.empty(0, np.int64)
        r = r[heads]
        spread = mix(pos[r].view(np.uint64) ^ dk[r].view(np.uint64)).view(np.int64)
        columns = [np.concatenate(x) for x in ((h[go], spread), (c[go], spread), (dk[go], dk[r]), (pos[go], pos[r]), (n[go], total), (off[go], np.full(len(r), _SETTLED)))]
        kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip(columns, kinds)], ["h", "c", "dk", "pos", "n", "off"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in batches:
            keys, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                values = s.split(batch.column(2)[i].as_py())
                # A longer text goes in pieces that share a window less one symbol.
                for at in range(0, max(1, len(values) - s.window + 1), BLOCK):
                    piece = values[at : at + BLOCK + s.window - 1]
                    for part, x in zip(held, (piece, keys[i], tags[i], at)):
                        part.append(x)
                    size += len(piece)
                    if size >= BLOCK:
                        yield block(*held)
                        held, size = ([], [], [], []), 0
        if held[0]:
            yield block(*held)

    return in_arrow(keyed.select("dk", "tk", "text"), run, RUNS)


def _classified(runs: DataFrame, s: Symbols) -> DataFrame:
    """(dk, pos, n, off, h, kind): 0 windows that are repeats, 1 runs to compare, 2 the same of frequent anchors.

    Runs of an anchor of one content alone are settled here; texts that nothing repeats leave no row.
    """
    same, anchor = W.partitionBy("h", "c"), W.partitionBy("h")
    here = F.struct("dk", "pos")
    first = runs.repartition("h").withColumn("first", F.min(here).over(same))
    later = here > F.col("first") if s.same_document else F.col("dk") > F.col("first.dk")
    marked = first.withColumn("later", later).select(
        "*", (F.min("c").over(anchor) != F.max("c").over(anchor)).alias("varied"),
        F.sum(F.when(F.col("later"), 0).otherwise(1)).over(anchor).alias("rivals"),
    )
    kind = F.when((F.col("off") == _SETTLED) | F.col("later"), 0).when(F.col("varied") & (F.col("rivals") <= HOT), 1).when(F.col("varied"), 2)
    return marked.withColumn("kind", kind).where("kind IS NOT NULL").select("dk", "pos", "n", "off", "h", "kind")


PIECES = "kind int, h bigint, d1 bigint, d2 bigint, dk bigint, pos bigint, n int, off int, raw binary"


def _pieces(asked: DataFrame, s: Symbols) -> DataFrame:
    """The symbols of runs to compare; of frequent anchors, each window by itself under two hashes of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, dk, tk, text, wanted = (batch.column(k)[i].as_py() for k in range(5))
                raw, out = s.raw(text), {name: [] for name in ("kind", "h", "d1", "d2", "dk", "pos", "n", "off", "raw")}
                hot = [x for x in wanted if x["kind"] == 2]
                rows = [(1, x["h"], 0, 0, dk, (tk << 32) + x["p"], x["n"], x["off"], raw[x["p"] : x["p"] + x["n"] + s.window - 1].tobytes()) for x in wanted if x["kind"] == 1]
                if hot:
                    at = np.concatenate([np.arange(x["p"], x["p"] + x["n"]) for x in hot])
                    values = s.split(text)
                    d1 = mix(Prefixes(values).of(at, s.window)).view(np.int64).tolist()
                    d2 = mix(Prefixes(mix(values), BASE_2).of(at, s.window)).view(np.int64).tolist()
                    rows += [(2, a, a, b, dk, (tk << 32) + p, 1, 0, b"") for a, b, p in zip(d1, d2, at.tolist())]
                for name, column in zip(out, zip(*rows)):
                    out[name] = column
                types = (pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], [*out])

    return in_arrow(asked.select("doc_id", "dk", "tk", "text", "wanted"), run, PIECES)


def _compared(pieces: DataFrame, s: Symbols, resolver: Resolver, width: int) -> DataFrame:
    """(dk, pos, n): windows of the pieces that occur in an earlier piece."""
    sorted_ = pieces.repartition("h").sortWithinPartitions("kind", "h", "d1", "d2", "dk", "pos")
    dtype = np.dtype(f"V{width}") if width > 1 else np.dtype(np.uint8)

    def spans(dk, pos) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(dk), pa.array(pos), pa.array(np.ones(len(dk), np.int32))], ["dk", "pos", "n"])

    def compare(rows: pa.Table) -> pa.RecordBatch:
        h, dk, pos, n, off = (rows.column(c).to_numpy() for c in ("h", "dk", "pos", "n", "off"))
        sizes = n + s.window - 1
        raw = np.frombuffer(b"".join(rows.column("raw").to_pylist()), dtype)
        base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        _, bucket = np.unique(np.stack([h[row], off[row] - step], axis=1), axis=0, return_inverse=True)
        classes = resolver(Candidates(raw, base[row] + step, bucket.ravel(), s.window))
        w_dk, w_pos = dk[row], pos[row] + step
        order = np.lexsort((w_pos, w_dk, classes))
        k, a, b = classes[order], w_dk[order], w_pos[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = k[1:] != k[:-1]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))
        later = a > a[first]
        if s.same_document:
            later |= (a == a[first]) & (b > b[first])
        return spans(a[later], b[later])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        leader = None  # of a frequent window: its hashes, and the first place that has it
        for batch in batches:
            t = pa.Table.from_batches([batch])
            kind = t.column("kind").to_numpy()
            few, many = t.slice(0, int((kind == 1).sum())), t.slice(int((kind == 1).sum()))
            if few.num_rows:
                waiting = few if waiting is None else pa.concat_tables([waiting, few])
                h = waiting.column("h").to_numpy()
                whole = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
                if whole >= 512 or many.num_rows:
                    whole = len(h) if many.num_rows else whole
                    for start, end in _groups(h[:whole]):
                        yield compare(waiting.slice(start, end - start))
                    waiting = waiting.slice(whole)
            if many.num_rows:
                d1, d2, dk, pos = (many.column(c).to_numpy() for c in ("d1", "d2", "dk", "pos"))
                fresh = np.ones(len(d1), bool)
                fresh[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
                fresh[0] = leader is None or (d1[0], d2[0]) != leader[:2]
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(d1)), -1))
                f_dk = np.where(first >= 0, dk[first], leader[2] if leader else 0)
                f_pos = np.where(first >= 0, pos[first], leader[3] if leader else 0)
                later = dk > f_dk
                if s.same_document:
                    later |= (dk == f_dk) & (pos > f_pos)
                leader = (d1[-1], d2[-1], f_dk[-1], f_pos[-1])
                yield spans(dk[later], pos[later])
        if waiting is not None and waiting.num_rows:
            for start, end in _groups(waiting.column("h").to_numpy()):
                yield compare(waiting.slice(start, end - start))

    return in_arrow(sorted_, run, "dk bigint, pos bigint, n int")


def _groups(h: np.ndarray, rows: int = 1024) -> Iterator[tuple[int, int]]:
    """Slices of about ``rows`` rows that do not part an anchor."""
    start = 0
    while start < len(h):
        end = min(start + rows, len(h))
        end = len(h) if end == len(h) else int(np.searchsorted(h, h[end - 1], side="right"))
        yield start, end
        start = end


def with_repeats(docs: DataFrame, s: Symbols, resolver: Resolver, width: int) -> DataFrame:
    """(doc_id, dk, tk, text, spans): the documents, null texts as empty, with the windows that occur before.

    ``spans`` lists (p, n): n windows from symbol p on; null without any.  Documents are ordered by doc_id
    (null first), rows of one doc_id by a hash of their text; repeated rows are one document.
    """
    keyed = docs.select("doc_id", text_of().alias("text")).select(
        "doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("dk"),
        # Never null, so that no join puts a filter of its own below the exchange.
        F.coalesce(F.pmod(F.xxhash64("text"), F.lit(1 << 31)), F.lit(0)).alias("tk"), "text",
    )
    known = cut(_classified(_runs(keyed, s), s))
    place = [F.shiftright("pos", 32).alias("tk"), F.col("pos").bitwiseAND(F.lit((1 << 32) - 1)).alias("p")]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed.repartition(partitions, "dk", "tk")  # one exchange for both joins
    wanted = known.where("kind > 0").select("dk", *place, "n", "off", "h", "kind").groupBy("dk", "tk").agg(F.collect_list(F.struct("p", "n", "off", "h", "kind")).alias("wanted"))
    asked = texts.join(wanted, ["dk", "tk"]).dropDuplicates(["dk", "tk"])
    more = _compared(_pieces(asked, s), s, resolver, width)
    found = known.where("kind = 0").select("dk", "pos", "n").unionByName(more).select("dk", *place, "n")
    spans = found.groupBy("dk", "tk").agg(F.collect_list(F.struct("p", "n")).alias("spans"))
    return texts.join(spans, ["dk", "tk"], "left").select("doc_id", "dk", "tk", "text", "spans")


def covered(spans: list[dict] | None, window: int) -> list[tuple[int, int]]:
    """Maximal stretches of symbols that the windows cover."""
    out: list[list[int]] = []
    for p, n in sorted((x["p"], x["n"]) for x in spans or ()):
        if out and p <= out[-1][1]:
            out[-1][1] = max(out[-1][1], p + n - 1 + window)
        else:
            out.append([p, p + n - 1 + window])
    return [(a, b) for a, b in out]
