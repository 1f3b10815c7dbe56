"""Removal of word windows that occur in an earlier document, by level-wise doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from clipscore.llm.common import in_arrow
from clipscore.llm.repeats import Candidates, Prefixes, Symbols, covered, with_repeats

WINDOW = 50
# Each level doubles the one before.  The grams that anchor windows are the first level found
# repeated, across the whole table; what survives is extended window by window.
LEVELS = (13, 25, WINDOW)


def _words(text: str) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    words = text.encode().split()
    return np.fromiter(map(digest, words), np.uint64, len(words))


def _raw(text: str) -> np.ndarray:
    """Two hashes a word, 16 bytes: what stands for a word when windows are compared."""
    words = text.encode().split()
    return np.frombuffer(b"".join(map(xxhash.xxh128_digest, words)), "V16")


def doubled_classes(c: Candidates) -> np.ndarray:
    """A class number a window, equal for equal windows of a bucket alone.

    Windows start as candidates of their bucket.  At each length those whose first words no other
    candidate of the bucket has are out, with a class of their own; the others are extended to twice
    the length.  The last length is compared word by word.
    """
    words = c.raw.view(np.uint64).reshape(-1, 2)
    prefixes = Prefixes(words[:, 0] ^ (words[:, 1] << np.uint64(1)))
    classes = np.arange(len(c.start), dtype=np.int64)
    alive = np.arange(len(c.start))
    for length in LEVELS:
        names = np.stack([c.bucket[alive].astype(np.uint64), prefixes.of(c.start[alive], length)], axis=1)
        _, group, count = np.unique(names, axis=0, return_inverse=True, return_counts=True)
        alive = alive[count[group.ravel()] > 1]
        if not len(alive):
            return classes
    view = np.lib.stride_tricks.sliding_window_view(c.raw.view(np.uint8), 16 * c.window)[::16]
    order = alive[np.lexsort((prefixes.of(c.start[alive], c.window), c.bucket[alive]))]
    same = c.bucket[order[1:]] == c.bucket[order[:-1]]
    for part in np.array_split(np.flatnonzero(same), max(1, int(same.sum()) // 16384)):
        same[part] = (view[c.start[order[part]]] == view[c.start[order[part + 1]]]).all(axis=1)
    classes[order] = len(classes) + np.cumsum(np.concatenate([[True], ~same]))
    return classes


WORDS = Symbols(WINDOW, LEVELS[0], _words, _raw, same_document=False)


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept of every document.

    A word goes if a window of ``WINDOW`` words that covers it also starts in a document with a smaller
    doc_id; kept words are joined by one space.  Windows are judged on the input.  Null, empty and wordless
    texts have no words, a text shorter than the window loses none; rows of one doc_id do not
    count against each other, a null doc_id is the smallest; an empty table gives an empty one; other
    columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for i in range(part.num_rows):
                    words = part.column(1)[i].as_py().encode().split()
                    gone = covered(part.column(2)[i].as_py(), WINDOW)
                    edges = [0, *[x for span in gone for x in span], len(words)]
                    left = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                    kept = b" ".join(left)
                    rows.append((len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode()))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    found = with_repeats(docs, WORDS, doubled_classes, 16)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(found.select("doc_id", "text", "spans"), run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
