"""SimHash near-duplicates: fingerprints of word shingles, linked by a grid join on segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipscore.llm.common import DOCUMENT_COLUMNS, cut, in_arrow
from clipscore.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
DISTANCE = 4
_BLOCK = 1 << 16
_PAIRS = 0x5555555555555555  # the lower bit of each two-bit segment

# Fingerprints within the distance have bit counts, over the 32 segments of two bits, at most that far
# apart in the Manhattan metric.  With the segments in seven groups, four units of distance touch at most
# four groups, so at least three groups have equal counts: the pair meets in that cell of one of the
# 35 grids, each over the coordinates of three groups.
GROUPS = 7
EQUAL_GROUPS = GROUPS - DISTANCE


def simhash(text: str | None) -> int:
    """64 bits, each set if over half the shingles' hashes have it; without words, zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist())
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", n)
    for at in range(0, n, _BLOCK):
        part = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp bigint")


def grid_masks() -> list[int]:
    """One mask over the segment counts (two bits each) for each choice of groups."""
    bounds = np.linspace(0, 32, GROUPS + 1).round().astype(int).tolist()
    group = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(bounds, bounds[1:])]
    return [sum(chosen) for chosen in combinations(group, EQUAL_GROUPS)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _unary(fps: np.ndarray) -> np.ndarray:
    """Segment counts 0, 1, 2 as bits 00, 01, 11: differing bits are then the Manhattan distance."""
    pairs = np.uint64(_PAIRS)
    low, high = fps & pairs, (fps >> np.uint64(1)) & pairs
    return ((low & high) << np.uint64(1)) | low | high


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (least, other) of each component of distinct fingerprints within the distance.

    Every fingerprint reached takes out of the rest all that lie near it, so a dense cell costs few
    steps and gives one link less than it has members.
    """
    order = np.sort(fps)
    counts, rest, out = _unary(order), np.arange(len(order)), []
    while len(rest):
        root, rest, front = rest[0], rest[1:], [rest[0]]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(counts[rest] ^ counts[at]) <= DISTANCE  # lower bound
            near[near] = np.bitwise_count(order[rest[near]] ^ order[at]) <= DISTANCE  # exact
            if near.any():
                got = rest[near].tolist()
                out.extend((root, x) for x in got)
                front.extend(got)
                rest = rest[~near]
    return [(int(order[a]), int(order[b])) for a, b in out]


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect any two of the distinct ``fp`` within the distance, through others if need be."""
    low, high = F.col("fp").bitwiseAND(F.lit(_PAIRS)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(_PAIRS))
    counts = F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low).bitwiseOR(high)  # as in _unary
    cells = [F.struct(F.lit(i).alias("grid"), F.col("counts").bitwiseAND(F.lit(_signed(m))).alias("cell")) for i, m in enumerate(grid_masks())]
    dealt = fps.select("fp", counts.alias("counts")).select("fp", F.inline(F.array(*cells))).repartition("grid", "cell").sortWithinPartitions("grid", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, cell, fp = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64)

        def closed(last: bool):
            """Links of the cells that are complete; the cell at the end may go on in the next batch."""
            nonlocal grid, cell, fp
            starts = np.concatenate([[0], np.flatnonzero((grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1])) + 1]) if len(fp) else np.empty(0, int)
            ends = np.append(starts[1:], len(fp)) if len(fp) else starts
            if not last and len(starts):
                starts, ends, keep = starts[:-1], ends[:-1], starts[-1]
            else:
                keep = len(fp)
            found = []
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                found += spanning_links(fp[a:b])
            grid, cell, fp = grid[keep:], cell[keep:], fp[keep:]
            pairs = np.array(sorted(set(found)), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            grid = np.concatenate([grid, batch.column(0).to_numpy()])
            cell = np.concatenate([cell, batch.column(1).to_numpy()])
            fp = np.concatenate([fp, batch.column(2).to_numpy().view(np.uint64)])
            yield closed(False)
        yield closed(True)

    return in_arrow(dealt.select("grid", "cell", "fp"), run, "a bigint, b bigint").distinct()


def _rooted(distinct: DataFrame) -> DataFrame:
    """Distinct ``fp`` with label (null where it links to none) and root, the name of its component."""
    found = components(links(distinct)).withColumnRenamed("node", "fp")
    return distinct.join(found, "fp", "left").withColumn("root", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id, linked of every document.

    Copies share a fingerprint, so linking works on distinct ones; two fingerprints link at ``DISTANCE`` or
    fewer differing bits, and component_id is the least doc_id reachable.  ``linked`` tells whether the
    fingerprint links to another.  Null, empty and wordless texts have fingerprint zero, linked like any
    other; repeated rows each get their row; a null doc_id takes part but is no component_id (null where
    there is no other); an empty table gives an empty one; other columns are not looked at.
    """
    printed = cut(fingerprints(docs))
    grouped = _rooted(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    known = grouped.join(least, "root").select("fp", "component_id", F.col("label").isNotNull().alias("linked"))
    return printed.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "linked")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of documents: the least doc_id, a null one last.

    Rows of one doc_id may differ: a digest of the other columns decides between them, and names the row that
    stays, so that the choice is the same whenever a task runs again.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    fields = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("null")) for c in DOCUMENT_COLUMNS if c != "doc_id"]
    named = docs.withColumn("digest", F.unhex(F.sha2(F.concat(*fields), 256)))
    turn = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    printed = cut(fingerprints(named.select(turn.alias("doc_id"), "text")))
    first = _rooted(printed.groupBy("fp").agg(F.min("doc_id").alias("least"))).groupBy("root").agg(F.min("least").alias("least"))
    stay = cut(first.select(F.col("least.doc_id").alias("id"), F.col("least.digest").alias("own")))
    kept = named.join(stay, named["doc_id"].eqNullSafe(stay["id"]) & (named["digest"] == stay["own"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "digest"]).select(*DOCUMENT_COLUMNS)
