import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing, tokens

PIECES = st.text(st.sampled_from(" ▁  \n\taeiouéßÑ<s>|1.,!?\x00　日本\U0001f600") | st.characters(exclude_categories=["Cs"]), max_size=60)


class Counter:
    """What the tasks do, in one process: some pre-tokens known, the others counted once each."""

    def __init__(self):
        self.pieces = tokens.Pieces(tokens.tokenizer_path("piece_bpe_32k.model"))
        self.model = self.pieces.model

    def count(self, texts, known=()):
        known = sorted(set(known))
        held = tokens.Known(known, self.pieces(known))
        out = []
        for a, b, spans in tokens.spans_of(texts):
            counts = held(spans)
            other = np.flatnonzero(counts < 0)
            counts[other] = self.pieces(spans.bytes_of(other))
            out += np.bincount(spans.row, counts[spans.which], b - a).astype(int).tolist()
        return out


@pytest.fixture(scope="module")
def counter():
    return Counter()


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder()


def test_counts_agree_with_the_library(counter):
    @settings(max_examples=400, deadline=None)
    @given(st.lists(PIECES, max_size=12), st.lists(PIECES, max_size=6))
    def check(texts, others):
        known = [b" " + x.replace(" ", "").replace("▁", "").encode() for x in others + texts[:4]]
        assert counter.count(pa.array(texts, pa.string()), known) == [len(x) for x in (counter.model.encode(t) for t in texts)]

    check()


def _thue_morse(n, a="a", b="b"):
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


def test_regular_words_are_told_apart(spark, frame, counter):
    texts = [w for n in (1024, 2048, 4096) for pair in (("a", "b"), ("x", "yz")) for w in _thue_morse(n, *pair)]
    expected = [len(counter.model.encode(t)) for t in texts]
    assert len(set(expected)) > 3
    assert counter.count(pa.array(texts)) == expected
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(frame(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_few_known_pretokens_change_nothing(spark, frame, counter):
    r = random.Random(3)
    words = [f"{r.choice('abc')}{k}" for k in range(300)] + ["=" * 80, "long" * 20, "-" * 2000]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(60))) + "  " * r.randrange(2) for _ in range(200)]
    docs = frame(list(enumerate(texts))).repartition(3)
    for frequent, frequent_long in ((0, 0), (7, 1), (10_000, 100)):
        got = {x.doc_id: x.n_tokens for x in tokens.token_counts(docs, frequent=frequent, frequent_long=frequent_long).collect()}
        assert got == {i: len(counter.model.encode(t)) for i, t in enumerate(texts)}


def test_ids_agree_with_the_library(encoder):
    import tokenizers

    slow = tokenizers.Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))

    @settings(max_examples=400, deadline=None)
    @given(st.lists(PIECES | st.sampled_from(["<|endoftext|>", "<|endo", "'s", "I'll  "]), max_size=6).map("".join))
    def check(text):
        assert encoder.encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids

    check()
    for text in (" " * 30_000 + "x", "a" * 30_000, "\n" * 5_000):
        assert encoder.encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_token_counts_query(spark, frame, counter):
    texts = ["", None, " ", "one two  three ", "x" * 100_000, "a b " * 5000] + ["same text"] * 30
    got = {r.doc_id: r for r in tokens.token_counts(frame(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        n = len(counter.model.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)
    assert tokens.token_counts(frame([])).collect() == []
    again = tokens.token_counts(frame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d")]), keep=("source",)).collect()
    assert sorted((r.doc_id or 0, r.source, r.n_tokens) for r in again) == [(0, "s", 1), (1, "s", 1), (1, "s", 2), (1, "s", 2)]


def test_fullest_is_the_best_subset():
    r = random.Random(5)
    for _ in range(300):
        items = [r.randrange(1, 30) for _ in range(r.randrange(0, 9))]
        space = r.randrange(0, 60)
        best = max(s for s in (sum(items[k] for k in range(len(items)) if m >> k & 1) for m in range(1 << len(items))) if s <= space)
        found = packing.fullest(space, sorted({n: items.count(n) for n in items}.items(), reverse=True))
        assert sum(n * k for n, k in found.items()) == best and all(k <= items.count(n) for n, k in found.items())


def test_plan_meets_the_lower_bound_where_lengths_vary():
    r = random.Random(9)
    histogram = {}
    for _ in range(20_000):
        n = r.randrange(1, 1025)
        histogram[n] = histogram.get(n, 0) + 1
    planned = packing.plan(histogram)
    total = sum(n * k for n, k in histogram.items())
    assert sum(times for _, times in planned) <= -(-total // 1024) + 40
    used = {}
    for found, times in planned:
        assert sum(n * k for n, k in found.items()) <= 1024
        for n, k in found.items():
            used[n] = used.get(n, 0) + k * times
    assert used == histogram


def test_packing_is_gapless_whole_and_tight(spark, frame, encoder):
    r = random.Random(2)
    texts = [" ".join(r.choice(["alpha", "be", "gamma7"]) for _ in range(r.choice([3, 50, 400, 3000]))) for _ in range(300)] + [None, ""] + ["copy of one"] * 200
    rows = packing.pack(frame(list(enumerate(texts)))).collect()
    ids = {i: encoder.encode(t or "").tolist() + [2] for i, t in enumerate(texts)}
    sequences = {}
    seen = {}
    for x in rows:
        part = ids[x.doc_id][x.start : x.start + x.length]
        assert len(part) == x.length and x.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
        seen.setdefault(x.doc_id, []).append((x.piece, x.start, x.length))
    for i, t in ids.items():
        own = sorted(seen[i])
        assert [p for p, _, _ in own] == list(range(len(own))) and own[0][1] == 0
        assert all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:])) and own[-1][1] + own[-1][2] == len(t)
        assert len(own) == -(-len(t) // 1024) and all(n == 1024 for _, _, n in own[1:])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    bins = []  # first fit, longest first
    for n in sorted((n for own in seen.values() for _, _, n in own), reverse=True):
        k = next((k for k, left in enumerate(bins) if left >= n), None)
        if k is None:
            bins.append(1024 - n)
        else:
            bins[k] -= n
    assert len(sequences) <= len(bins)
    assert packing.pack(frame([])).collect() == []


def test_packing_of_repeated_rows(spark, frame):
    rows = packing.pack(frame([(1, "a b c"), (1, "a b c"), (1, "d"), (None, None), (None, "a b c")]).repartition(3)).collect()
    assert len(rows) == 5 and sorted((x.doc_id or 0, x.length) for x in rows) == [(0, 1), (0, 4), (1, 2), (1, 4), (1, 4)]
    assert sorted((x.offset, x.offset + x.length) for x in rows if x.sequence_id == rows[0].sequence_id)[-1][1] == 15
