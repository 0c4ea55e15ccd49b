import random

import numpy as np
import pyarrow as pa

from millrace.llm import common as C


def test_lookup_knows_every_code_and_no_other():
    r = np.random.default_rng(1)
    codes = r.integers(0, 2**63, 50_000).astype(np.uint64)
    asked = np.concatenate([codes, r.integers(0, 2**63, 50_000).astype(np.uint64), np.zeros(1, np.uint64)])
    order = np.sort(codes)
    found = C.Lookup(codes)(asked)
    assert (order[found[:50_000] - 1] == codes).all() and (found[50_000:] == 0).all()
    assert (C.Lookup(codes[:0])(asked) == 0).all()


def test_shingles_are_those_of_the_plain_form():
    r = random.Random(1)
    texts = ["".join(r.choice("aAbB \n\té\x0b ") for _ in range(r.randrange(0, 80))) for _ in range(2000)] + [None, "", "a b c d e", "a b", "A B", "x" * 100_000]
    data, offsets = C.buffer_of(pa.array(texts))
    hashes, at = C.shingles(data, offsets)
    known = {}
    for i, t in enumerate(texts):
        own, made = C.shingle_set(t), frozenset(hashes[at[i] : at[i + 1]].tolist())
        assert len(own) == len(made) and known.setdefault(frozenset(own), made) == made


def test_long_texts_are_hashed_in_pieces_as_in_one(monkeypatch):
    text = "alpha beta gamma " * 3000
    whole = C.word_hashes(*C.buffer_of(pa.array([text, text])))[0]
    monkeypatch.setattr(C, "CHUNK_BYTES", 1000)
    assert (C.word_hashes(*C.buffer_of(pa.array([text, text])))[0] == whole).all()


def test_foremost_rows_are_bounded_and_the_largest(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") % 1000 + 1).alias("n"))
    for most in (0, 1, 100, 1500, 5000):
        found = sorted((r.n for r in C.foremost(df, "n", "key", most).collect()), reverse=True)
        assert len(found) <= most and (most > 3000 or len(found) >= 0.85 * most - 3)
        assert not found or found[-1] >= 0.9 * (1000 - most / 3)
    assert C.foremost(df.filter("n < 0"), "n", "key", 5).collect() == []
    equal = spark.range(3000).select("id", F.lit(7).cast("long").alias("n"))
    assert 350 < C.foremost(equal, "n", "id", 500).count() <= 500


def test_any_long_has_its_range(spark):
    ids = [-(2**63), -(2**53) - 1, -1, 0, 1, 2**53, 2**53 + 1, 2**63 - 2, 2**63 - 1]
    ends = np.array([-(2**53) - 2, -1, 2**53, 2**63 - 2], np.int64)
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "id long")
    got = {r.id: r.at for r in C.in_ranges(df, "id", ends, "at").collect()}
    assert got == {i: int((ends < np.int64(i)).sum()) for i in ids} | {None: 0}


def test_regular_texts_have_hashes_of_their_own():
    x, y, texts = "a", "b", []
    for _ in range(12):
        x, y = x + y, y + x
        texts += [x, y]
    texts += ["a" * k for k in range(1, 300)] + ["ab" * k for k in range(1, 300)] + ["abcdefgh" * k + "x" for k in range(40)]
    texts = sorted(set(texts))
    data, offsets = C.buffer_of(pa.array(texts))
    hashes = C.hash_spans(data, offsets[:-1], offsets[1:])
    assert len(set(hashes.tolist())) == len(texts)
    order = np.random.default_rng(0).permutation(len(texts))
    assert (C.hash_spans(data, offsets[:-1][order], offsets[1:][order]) == hashes[order]).all()
    upper = C.buffer_of(pa.array([t.upper() for t in texts]))[0]
    assert (C.hash_spans(upper, offsets[:-1], offsets[1:], fold=True) == C.hash_spans(data, offsets[:-1], offsets[1:], fold=True)).all()
