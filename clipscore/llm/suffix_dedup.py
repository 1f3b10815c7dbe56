"""Exact substring removal over bytes: candidate suffixes sorted by hashed comparisons."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clipscore.llm.common import in_arrow
from clipscore.llm.repeats import Candidates, Prefixes, Symbols, covered, mix, with_repeats

WINDOW = 100
GRAM = 32
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))  # a number for each byte


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


class SuffixOrder:
    """Compares suffixes of a buffer, up to ``limit`` symbols, by prefix polynomial hashes.

    The common extension of two suffixes is found by binary search on its length; the symbols
    behind it decide.
    """

    def __init__(self, raw: np.ndarray, limit: int) -> None:
        self.raw, self.limit = raw, limit
        self.prefixes = Prefixes(_VALUE[raw])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.limit)
        for _ in range(self.limit.bit_length()):
            middle = (low + high + 1) >> 1
            equal = self.prefixes.of(x, middle) == self.prefixes.of(y, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = self.common(x, y)
        at = np.minimum(k, self.limit - 1)
        return (k < self.limit) & (self.raw[x + at] < self.raw[y + at])


def merge_sorted(order: SuffixOrder, start: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Indices by bucket, then by suffix: a mergesort from the bottom up, all buckets at once.

    An element's place after a merge is its place in its own half plus its rank in the other half, by binary search.
    """
    index = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket)
    first = (np.cumsum(sizes) - sizes)[bucket[index]]
    size = sizes[bucket[index]]
    width = 1
    while width < sizes.max(initial=0):
        todo = np.flatnonzero(size > width)
        local = todo - first[todo]
        block = local // (2 * width) * (2 * width)
        in_left = local - block < width
        mine = np.where(in_left, block, block + width)
        low = np.where(in_left, block + width, block)
        high = np.minimum(np.where(in_left, block + 2 * width, block + width), size[todo])
        low = np.minimum(low, high)
        other, x = low.copy(), start[index[todo]]
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            y = start[index[first[todo[open_]] + middle]]
            # Left before right where equal: right elements go behind equal left ones.
            left, ahead = in_left[open_], np.empty(len(open_), bool)
            ahead[left] = order.less(y[left], x[open_[left]])
            ahead[~left] = ~order.less(x[open_[~left]], y[~left])
            low[open_], high[open_] = np.where(ahead, middle + 1, low[open_]), np.where(ahead, high[open_], middle)
        target = first[todo] + block + (local - mine) + (low - other)
        moved = index.copy()
        moved[target] = index[todo]
        index, width = moved, 2 * width
    return index


def suffix_classes(c: Candidates) -> np.ndarray:
    """A class number a window, equal for equal windows of a bucket alone.

    Neighbours in suffix order whose common extension is a whole window are equal if their bytes are, too; should
    a hash ever deceive, the windows are classed by their bytes.
    """
    order = SuffixOrder(c.raw, c.window)
    index = merge_sorted(order, c.start, c.bucket)
    at = c.start[index]
    near = np.flatnonzero(c.bucket[index[1:]] == c.bucket[index[:-1]])
    near = near[order.common(at[near], at[near + 1]) >= c.window]
    view = np.lib.stride_tricks.sliding_window_view(c.raw, c.window)
    for part in np.array_split(near, max(1, len(near) // 65536)):
        if not (view[at[part]] == view[at[part + 1]]).all():
            _, classes = np.unique(np.concatenate([view[c.start], c.bucket[:, None].astype("<i8").view(np.uint8)], axis=1), axis=0, return_inverse=True)
            return classes.ravel()
    fresh = np.ones(len(index), bool)
    fresh[near + 1] = False
    classes = np.empty(len(index), np.int64)
    classes[index] = np.cumsum(fresh)
    return classes


BYTES = Symbols(WINDOW, GRAM, lambda text: _VALUE[_bytes(text)], _bytes, same_document=True)


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept of every document.

    A byte goes if a ``WINDOW``-byte string that covers it also starts earlier: in a document before, or further up
    in the same one.  Strings are judged on the input.  Null and empty texts have no bytes, a text
    shorter than the window loses none; rows of one doc_id count as documents ordered by a hash of
    their text, repeated rows as one document, a null doc_id as the smallest; an empty table gives an
    empty one; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for i in range(part.num_rows):
                    raw = part.column(1)[i].as_py().encode()
                    gone = covered(part.column(2)[i].as_py(), WINDOW)
                    edges = [0, *[x for span in gone for x in span], len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    found = with_repeats(docs, BYTES, suffix_classes, 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(found.select("doc_id", "text", "spans"), run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
