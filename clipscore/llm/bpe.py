"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by merging bytes, short ones many at a time."""

from __future__ import annotations

import base64
import heapq
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipscore.llm.common import in_arrow

_MASK = (1 << 64) - 1
_STRIDE = 0x9E3779B97F4A7C15
_CACHE_ENTRIES = 1 << 18  # pre-tokens a worker remembers; it only saves time
_CACHED_CHARS = 64
_BATCH_CHARS = 1 << 19
_BATCH_IDS = 1 << 18
_MERGED_BYTES = 1 << 20  # of pre-tokens merged at a time
_NO_RANK = (1 << 31) - 1


class PerfectHash:
    """Key bytes to rank through as many slots as keys.

    Keys fall into buckets by one half of a 64-bit hash.  Buckets, largest first, get the first
    displacement that moves all their keys to free slots; a bucket of one key stores its slot itself,
    as a negative number.  A looked-up key is compared with the key in its slot.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = len(ranks)
        self.buckets = max(1, self.size // 4)
        self.shift = [0] * self.buckets
        self.keys: list[bytes] = [b""] * self.size
        self.ranks = [-1] * self.size
        members: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in ranks:
            h = xxhash.xxh64_intdigest(key)
            members[h % self.buckets].append((h, key))
        taken = np.zeros(self.size, bool)
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        singles = [b for b in order if len(members[b]) == 1]
        for b in order:
            if len(members[b]) > 1:
                hashes = np.array([h for h, _ in members[b]], np.uint64)
                self.shift[b] = self._displacement(hashes, taken)
                for h, key in members[b]:
                    self._put(self._slot(h, self.shift[b]), key, ranks[key], taken)
        for b, slot in zip(singles, np.flatnonzero(~taken).tolist()):
            self.shift[b] = -1 - slot
            self._put(slot, members[b][0][1], ranks[members[b][0][1]], taken)

    def _slot(self, h: int, shift: int) -> int:
        return -1 - shift if shift < 0 else (((h ^ (shift * _STRIDE & _MASK)) * _STRIDE & _MASK) >> 32) % self.size

    def _displacement(self, hashes: np.ndarray, taken: np.ndarray) -> int:
        low = 0
        while True:
            shifts = np.arange(low, low + 256, dtype=np.uint64)
            with np.errstate(over="ignore"):
                mixed = (hashes[None, :] ^ (shifts * np.uint64(_STRIDE))[:, None]) * np.uint64(_STRIDE)
            slots = np.sort((mixed >> np.uint64(32)) % np.uint64(self.size), axis=1)
            fits = ~taken[slots].any(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1)
            if fits.any():
                return low + int(fits.argmax())
            low += 256

    def _put(self, slot: int, key: bytes, rank: int, taken: np.ndarray) -> None:
        self.keys[slot], self.ranks[slot], taken[slot] = key, rank, True

    def get(self, key: bytes) -> int:
        """The rank, or -1."""
        if not self.size:
            return -1
        h = xxhash.xxh64_intdigest(key)
        slot = self._slot(h, self.shift[h % self.buckets])
        return self.ranks[slot] if self.keys[slot] == key else -1


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 token and rank.  Read on the driver; its size is the vocabulary's."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank, leftmost first, merges until no pair is a token.

    Parts are linked by the offset where the next begins.  A heap entry packs (rank, left, end); it is
    stale once its part is gone (link 0) or has grown.
    """
    n = len(piece)
    base, after, before = n + 1, list(range(1, n + 2)), list(range(-1, n))
    rank_of = ranks.get
    heap = [(rank * base + i) * base + i + 2 for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rest, end = divmod(heapq.heappop(heap), base)
        left = rest % base
        middle = after[left]
        if not 0 < middle < n or after[middle] != end:
            continue
        after[left], after[middle] = end, 0
        if end < n:
            before[end] = left
            if (rank := rank_of(piece[left : after[end]])) is not None:
                heapq.heappush(heap, (rank * base + left) * base + after[end])
        if left and (rank := rank_of(piece[before[left] : end])) is not None:
            heapq.heappush(heap, (rank * base + before[left]) * base + end)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class Pairs:
    """Rank of the token that two neighbouring parts make, for whole arrays of parts.

    A part is the rank of its token; a byte that is no token has a number beyond all ranks.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.beyond = max(ranks.values(), default=-1) + 1
        parts = {bytes([b]): self.beyond + b for b in range(256)} | ranks
        self.of_byte = np.array([parts[bytes([b])] for b in range(256)], np.int64)
        made = {(1 << 63) - 1: _NO_RANK}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = parts.get(token[:at]), parts.get(token[at:])
                if left is not None and right is not None:
                    made[left << 32 | right] = rank
        keys = np.fromiter(made, np.int64, len(made))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(made.values(), np.int64, len(made))[order]
        self.of_two_bytes = self.get(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks, or _NO_RANK."""
        wanted = left << 32 | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NO_RANK)


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[bytes]:
    """Ids of many short, non-empty pre-tokens, each as :func:`merge_bytes` finds them, as little-endian bytes.

    The parts of all pre-tokens lie in one array, beside each the rank of its pair with the next.  A round
    merges in every pre-token the pair of lowest rank, leftmost first; those without a pair leave.
    """
    out = [b""] * len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts, names = np.cumsum(sizes) - sizes, np.arange(len(pieces))
    letters = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    parts, rank = pairs.of_byte[letters], pairs.of_two_bytes[letters << 8 | np.roll(letters, -1)]
    rank[starts + sizes - 1] = _NO_RANK
    while len(names):
        best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
        at, live = (best & 0xFFFFFFFF) - starts, best >> 32 != _NO_RANK
        if not live.all():
            inside = np.repeat(live, sizes)
            if (ended := parts[~inside]).max() >= pairs.beyond:
                raise KeyError(f"byte {np.flatnonzero(pairs.of_byte == ended.max())[0]} is no token")
            ids, ends = ended.astype("<i4").tobytes(), np.cumsum(sizes[~live]) * 4
            for name, start, end in zip(names[~live].tolist(), (ends - sizes[~live] * 4).tolist(), ends.tolist()):
                out[name] = ids[start:end]
            parts, rank, names, sizes, at = parts[inside], rank[inside], names[live], sizes[live], at[live]
            starts = np.cumsum(sizes) - sizes
        at += starts
        parts[at] = rank[at]
        stays = np.ones(len(parts), bool)
        stays[at + 1] = False
        parts, rank = parts[stays], rank[stays]
        gone = np.arange(len(names))
        at, starts, sizes = at - gone, starts - gone, sizes - 1
        last, first = at == starts + sizes - 1, at == starts
        rank[at[last]] = _NO_RANK
        for left in (at[~last], at[~first] - 1):
            rank[left] = pairs.get(parts[left], parts[left + 1])
    return out


class _Ids(dict):
    """Pre-token to its ids as little-endian bytes: short ones are learnt, long ones worked out on each use."""

    def __init__(self, table: PerfectHash, pairs: Pairs) -> None:
        self.table, self.pairs = table, pairs
        self.ranks = dict(zip(table.keys, table.ranks))

    def of_texts(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of the pre-tokens of each text, learnt for all texts at once, or for blocks of a long text."""
        if sum(map(len, texts)) <= _CACHE_ENTRIES:
            self.learn(set().union(*texts))
            return [b"".join(map(self.__getitem__, pieces)) for pieces in texts]
        blocks = ((pieces[i : i + _CACHE_ENTRIES] for i in range(0, len(pieces), _CACHE_ENTRIES)) for pieces in texts)
        return [b"".join(self.of_texts([block])[0] for block in own) for own in blocks]

    def learn(self, pieces: set[str]) -> None:
        """From now on the short ones of ``pieces`` are known; others are forgotten when they would be too many."""
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > _CACHE_ENTRIES:
            self.clear()
            new = list(pieces)
        short, tokens, held = [], [], 0
        for piece in new:
            if 0 < len(piece) <= _CACHED_CHARS:
                token = piece.encode()
                rank = self.table.get(token)
                if rank >= 0:
                    self[piece] = struct.pack("<i", rank)
                else:
                    short.append(piece)
                    tokens.append(token)
                    held += len(token)
            if held >= _MERGED_BYTES:
                self.update(zip(short, merge_many(tokens, self.pairs)))
                short, tokens, held = [], [], 0
        self.update(zip(short, merge_many(tokens, self.pairs)))

    def __missing__(self, piece: str) -> bytes:
        token = piece.encode()
        rank = self.table.get(token)
        return array("i", [rank] if rank >= 0 else merge_bytes(token, self.ranks)).tobytes()


def _batches(columns: list[pa.Array], lengths: list[int], values: list, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("i4")
    flat = pa.array(np.concatenate(values) if values else np.empty(0, "<i4"), kind)
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), flat)], names)


def _joined(ids: pa.Array, by_rank: pa.Array) -> pa.Array:
    """For each list of ids the bytes of its tokens, which lie one after the other in what ``take`` returns."""
    tokens = by_rank.take(ids.flatten())
    lengths = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
    token_ends = np.cumsum(pc.binary_length(tokens).to_numpy(zero_copy_only=False), dtype="i4")
    offsets = np.append(np.int32(0), token_ends)[np.append(0, np.cumsum(lengths, dtype="i8"))]
    return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), tokens.buffers()[2]])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids`` (array<int>) of every whole text.

    Each match of ``pattern`` is encoded on its own, without special tokens.  Null and empty texts have
    no ids; repeated rows each get their row; an empty table gives an empty one.  Columns other than
    ``text`` and ``keep`` are not looked at.  The vocabulary, of fixed size, is broadcast.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast((PerfectHash(ranks), Pairs(ranks)))
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, split = _Ids(*vocabulary.value), regex.compile(pattern).findall
        for batch in batches:
            texts, start, held, pieces = batch.column(len(keep)), 0, 0, []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                pieces.append(split(text))
                held += len(text)
                if held >= _BATCH_CHARS or i == batch.num_rows - 1:
                    values = [np.frombuffer(x, "<i4") for x in ids.of_texts(pieces)]
                    rows = [batch.column(c).slice(start, i + 1 - start) for c in range(len(keep))]
                    yield _batches(rows, list(map(len, values)), values, pa.int32(), [*keep, "ids"])
                    start, held, pieces = i + 1, 0, []

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids array<int>"
    return in_arrow(docs.select(*keep, "text"), run, schema)


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The columns of ``tokens`` and ``decoded`` (binary): the bytes its ``ids`` stand for; null ids are empty."""
    spark = tokens.sparkSession
    by_rank: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_rank[rank] = token
    shared = spark.sparkContext.broadcast(pa.array(by_rank, pa.binary()))
    names = tokens.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False), dtype="i8")
            stop = 0
            while (start := stop) < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + _BATCH_IDS, "right")))
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns, _joined(part.column(at), shared.value)], [*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema) + ", decoded binary"
    return in_arrow(tokens, run, schema)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ids, n_tokens, ids_sha256, decoded_sha256, from what :func:`encode` and :func:`decode` return."""
    tokens = encode(docs, ranks, pattern, keep)
    digest = tokens.select(
        "*", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
    )
    return decode(digest, ranks).select(*keep, "ids", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pre-token pattern of an installed public tokenizer."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN
