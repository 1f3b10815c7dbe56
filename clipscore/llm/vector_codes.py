"""Product codes of integer vectors; distances are gathered from tables over per-dimension value dictionaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipscore.llm.common import attach, cut, in_arrow

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
_BLOCK_CELLS = 1 << 20


def largest_component(width: int) -> int:
    """Components beyond this count as this: then squared distances of whole vectors always fit a long."""
    return 1 << ((61 - (width - 1).bit_length()) // 2)


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of every component, shorter vectors filled with zeros: (rows, width) longs."""
    lengths = np.asarray(vectors.value_lengths(), np.int64)
    x = np.asarray(vectors.flatten(), np.float64)
    bound = float(largest_component(width))
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = np.clip(np.floor(SCALE * x), -bound, bound).astype(np.int64)
    return out


class Block:
    """Rows as codes into one sorted dictionary of distinct integers per dimension."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, codes: np.ndarray) -> None:
        self.words = np.split(words, np.cumsum(sizes)[:-1])
        self.codes = codes.reshape(len(sizes), -1)

    def assign(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part (lowest index on ties) and its squared distance: two (parts, rows).

        A table of squared differences of each dictionary word to all entries serves all rows; a part's
        distances are the sum of the rows' gathers from it.
        """
        parts, entries, width = books.shape
        nearest = np.empty((parts, self.codes.shape[1]), np.int64)
        error = np.empty_like(nearest)
        for p in range(parts):
            total = np.zeros((self.codes.shape[1], entries), np.int64)
            for q in range(width):
                squares = (self.words[p * width + q][:, None] - books[p, :, q][None, :]) ** 2
                total += squares[self.codes[p * width + q]]
            nearest[p] = total.argmin(axis=1)
            error[p] = total.min(axis=1)
        return nearest, error

    def sums(self, nearest: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Component sums (parts, entries, width) and counts (parts, entries) of the rows of each entry."""
        parts = len(nearest)
        width = len(self.words) // parts
        sums = np.zeros((parts, entries, width), np.int64)
        for p in range(parts):
            for q in range(width):
                words = self.words[p * width + q]
                met = np.bincount(self.codes[p * width + q] * np.int64(entries) + nearest[p], minlength=len(words) * entries)
                sums[p, :, q] = words @ met.reshape(len(words), entries)
        return sums, np.stack([np.bincount(n, minlength=entries) for n in nearest])


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """Rows (vec_id, label, embedding) as blocks of dictionary codes, one row a block."""
    most = max(1, min(1 << 16, _BLOCK_CELLS // width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                values = integers(part.column(2), width)
                found = [np.unique(values[:, j], return_inverse=True) for j in range(width)]
                whole = lambda column: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), column)
                codes = np.stack([c.reshape(-1) for _, c in found]).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [whole(part.column(0)), whole(part.column(1)), pa.array([[len(w) for w, _ in found]], pa.list_(pa.int32())),
                     pa.array([np.concatenate([w for w, _ in found])], pa.list_(pa.int64())), pa.array([codes.tobytes()], pa.binary())],
                    ["ids", "labels", "sizes", "words", "codes"],
                )

    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    schema = f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, sizes array<int>, words array<bigint>, codes binary"
    return in_arrow(rows.select("vec_id", "label", "embedding"), run, schema)


def _read(batch: pa.RecordBatch, i: int) -> Block:
    sizes, words = (batch.column(batch.schema.get_field_index(c))[i].values.to_numpy() for c in ("sizes", "words"))
    return Block(sizes, words, np.frombuffer(batch.column(batch.schema.get_field_index("codes"))[i].as_py(), "<u2").astype(np.int64))


def _refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries become the floored means of their parts; unused entries stay.

    A task sends one row of sums; the driver gets as many numbers as the codebooks hold.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                block = _read(batch, i)
                s, c = block.sums(block.assign(books)[0], entries)
                sums, counts = sums + s, counts + c
        flat = np.concatenate([sums.reshape(-1), counts.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.int64()))], ["sums"])

    partial = in_arrow(blocks.select("sizes", "words", "codes"), run, "sums array<bigint>").select(F.posexplode("sums").alias("at", "part"))
    found = partial.groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    total = [0] * (books.size + parts * entries)
    for row in found:
        total[row["at"]] = int(row["total"])
    out = books.copy()
    for cell, count in enumerate(total[books.size :]):
        if count:
            out.reshape(-1, width)[cell] = [s // count for s in total[cell * width : (cell + 1) * width]]
    return out


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part.

    Vectors that are null or hold null or non-finite components take none.  Components become
    floor(4096 * x), clipped to ``largest_component`` (2^27 at 64 dimensions) so that errors fit a long.  Lengths that
    ``parts`` does not divide, shorter and empty vectors are filled up with zeros to the longest.
    Codebooks start at the rows of the ``entries`` least vec_ids (null last, equal ids by their vectors;
    fewer rows, fewer entries).  Repeated rows each count and each get their row; null labels share
    one label_error, null where it is beyond a long.  An empty table gives an empty one; other
    columns are not looked at.

    Vectors are encoded once, a block of rows over its own dictionaries; every round reads the written
    codes and only its codebooks (parts x entries x width numbers) pass through the driver.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & ~odd)
    width = kept.agg(F.max(F.size("embedding"))).first()[0] or 1
    width = -(-width // parts) * parts
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).toArrow()
    start = integers(first.column(0).combine_chunks(), width)
    books = np.ascontiguousarray(start.reshape(len(start), parts, width // parts).transpose(1, 0, 2))
    blocks = cut(_blocks(kept, width))
    for _ in range(rounds if len(start) else 0):
        before, books = books, _refined(blocks, books)
        if np.array_equal(before, books):
            break  # further rounds change nothing
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    hexed = np.array([f"{e:02x}" for e in range(max(1, entries))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nearest, error = _read(batch, i).assign(books)
                codes = pa.array(["".join(row) for row in hexed[nearest.T].tolist()])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, codes, pa.array(error.sum(axis=0))], ["vec_id", "label", "code", "error"])

    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    coded = cut(in_arrow(blocks, run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error bigint"))
    whole = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error")
    labels = cut(coded.groupBy("label").agg(whole, F.count("*").alias("rows")))
    return attach(coded, labels, "label", "rows").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def compress_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for :func:`compress` on vectors of one length that ``parts`` divides, within the bound of components."""
    steps = []
    nearest = (
        "a{i} AS MATERIALIZED (SELECT rid, p, min(d * {k} + e) % {k} AS e, min(d * {k} + e) // {k} AS err FROM"
        " (SELECT x.rid, x.p, b.e, sum((x.v - b.v) ** 2)::BIGINT AS d FROM x JOIN b{i} b ON x.p = b.p AND x.q = b.q GROUP BY x.rid, x.p, b.e) GROUP BY rid, p)"
    )
    moved = (
        "b{j} AS MATERIALIZED (SELECT b.p, b.e, b.q, coalesce((s - ((s % n) + n) % n) // n, b.v) AS v FROM b{i} b LEFT JOIN"
        " (SELECT x.p, a.e, x.q, sum(x.v)::BIGINT AS s, count(*) AS n FROM x JOIN a{i} a ON x.rid = a.rid AND x.p = a.p GROUP BY x.p, a.e, x.q) m ON b.p = m.p AND b.e = m.e AND b.q = m.q)"
    )
    for i in range(rounds):
        steps += [nearest.format(i=i, k=entries), moved.format(i=i, j=i + 1)]
    steps.append(nearest.format(i=rounds, k=entries))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
flat AS (SELECT rid, len(embedding) // {parts} AS w, unnest(embedding) AS c, generate_subscripts(embedding, 1) - 1 AS j FROM kept),
x AS MATERIALIZED (SELECT rid, j // w AS p, j % w AS q, floor({SCALE} * c::DOUBLE)::BIGINT AS v FROM flat),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, q, v FROM x WHERE rid <= {entries}),
{", ".join(steps)},
book AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, q)) AS codebooks_sha256 FROM b{rounds}),
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(err)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), book"""
