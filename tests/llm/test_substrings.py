"""Byte and word removal against plain Python, and their parts."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clipscore.llm import repeats, substring_dedup, suffix_dedup
from tests.llm.data import PASSAGE, documents, frame


def plain_bytes(data):
    """Repeated rows are one document."""
    unique, out, seen = sorted({(r[0], (r[1] or "").encode()) for r in data}), {}, set()
    for doc, raw in unique:
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc, raw] = (doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out[r[0], (r[1] or "").encode()] for r in data)


def plain_words(data):
    first, texts = {}, sorted((r[0], (r[1] or "").encode().split()) for r in data)
    out = []
    for doc, words in texts:
        gone = [0] * len(words)
        for p in range(len(words) - 49):
            if first.setdefault(tuple(words[p : p + 50]), doc) < doc:
                gone[p : p + 50] = [1] * 50
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 4])
def test_removal_equals_plain_python(spark, monkeypatch, hot):
    """Also with almost every shared anchor treated as a frequent one."""
    monkeypatch.setattr(repeats, "HOT", hot)
    data = documents()
    got = suffix_dedup.remove_repeated_bytes(frame(spark, data)).drop("kept").collect()
    assert sorted(map(tuple, got)) == plain_bytes(data)
    got = substring_dedup.remove_repeated_words(frame(spark, data)).drop("kept").collect()
    assert sorted(map(tuple, got)) == plain_words(data)


def test_kept_text_and_empty_tables(spark):
    rows = [(1, PASSAGE, None, None, 1), (2, "x " + PASSAGE, None, None, 1), (None, PASSAGE, None, None, 1)]
    kept = {r.doc_id: r.kept for r in substring_dedup.remove_repeated_words(frame(spark, rows)).collect()}
    assert kept == {None: PASSAGE, 1: "", 2: "x"}
    raw = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeated_bytes(frame(spark, rows)).collect()}
    assert raw == {None: PASSAGE.encode(), 1: b"", 2: b"x "}
    assert suffix_dedup.remove_repeated_bytes(frame(spark, [])).count() == 0
    assert substring_dedup.remove_repeated_words(frame(spark, [])).count() == 0


def test_rows_of_one_id_do_not_mix(spark):
    rows = [(1, "left " + PASSAGE, None, None, 1), (1, PASSAGE + " right", None, None, 1)]
    got = suffix_dedup.remove_repeated_bytes(frame(spark, rows)).collect()
    assert sum(r.n_removed > 0 for r in got) == 1
    got = substring_dedup.remove_repeated_words(frame(spark, rows)).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_long_texts_go_in_pieces(monkeypatch):
    """Windows of all pieces together are those of the whole."""
    s = suffix_dedup.BYTES
    values = s.split("ab c" * 3000 + PASSAGE)
    whole = repeats.anchored_runs(values, np.array([0, len(values)]), s)
    pieces = set()
    for at in range(0, len(values) - s.window + 1, 700):
        part = values[at : at + 700 + s.window - 1]
        begin, n, off, h, _ = repeats.anchored_runs(part, np.array([0, len(part)]), s)
        pieces |= {(b + at + i, x) for b, k, x in zip(begin.tolist(), n.tolist(), h.tolist()) for i in range(k)}
    assert pieces == {(b + i, x) for b, k, x in zip(whole[0].tolist(), whole[1].tolist(), whole[3].tolist()) for i in range(k)}


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=400).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 12), st.integers(1, 4))
def test_suffix_order_is_lexicographic(raw, limit, buckets):
    buffer = np.frombuffer(raw, np.uint8)
    start = np.arange(max(0, len(raw) - limit + 1))
    bucket = start % buckets
    order = suffix_dedup.merge_sorted(suffix_dedup.SuffixOrder(buffer, limit), start, bucket)
    keys = [(int(bucket[i]), raw[i : i + limit]) for i in order]
    assert keys == sorted(keys)
    classes = suffix_dedup.suffix_classes(repeats.Candidates(buffer, start, bucket, limit)) if len(start) else np.empty(0)
    named = {}
    for i, c in enumerate(classes.tolist()):
        assert named.setdefault((int(bucket[i]), raw[i : i + limit]), c) == c
    assert len(set(named.values())) == len(named)


def test_deceived_hashes_fall_back_to_bytes(monkeypatch):
    monkeypatch.setattr(suffix_dedup.SuffixOrder, "common", lambda self, x, y: np.full(len(x), self.limit))
    raw = np.frombuffer(b"abcabdabc", np.uint8)
    got = suffix_dedup.suffix_classes(repeats.Candidates(raw, np.array([0, 3, 6]), np.zeros(3, int), 3)).tolist()
    assert got[0] == got[2] != got[1]


def test_doubling_keeps_equal_windows_alone():
    rng = np.random.default_rng(3)
    words = [str(x) for x in rng.integers(0, 3, 400)]
    text = " ".join(words * 2)
    raw = substring_dedup._raw(text)
    start = np.arange(len(raw) - 49)
    classes = substring_dedup.doubled_classes(repeats.Candidates(raw, start, np.zeros(len(start), int), 50)).tolist()
    both, named = words * 2, {}
    for p, c in enumerate(classes):
        assert named.setdefault(tuple(both[p : p + 50]), c) == c
    assert len(set(named.values())) == len(named)


def test_covered_stretches_are_maximal():
    assert repeats.covered([{"p": 5, "n": 2}, {"p": 15, "n": 1}, {"p": 40, "n": 1}], 10) == [(5, 25), (40, 50)]
    assert repeats.covered(None, 10) == []
