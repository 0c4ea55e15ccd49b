import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import common as C
from millrace.llm import components, ngram_join


def plain(rows, percent=75):
    """Every pair, and reach over the links."""
    sets = {i: C.shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def texts(n, seed, words=400, passage=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    common = [r.choice(vocabulary) for _ in range(passage)]
    out = []
    while len(out) < n:
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 6, 12, 40, 120]))]
        if r.random() < 0.3:
            base = common[: r.randrange(5, passage)] + base
        for _ in range(r.choice([1, 1, 2, 5, 25])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(("  " if r.random() < 0.2 else " ").join(copy).upper() if r.random() < 0.1 else " ".join(copy))
    r.shuffle(out)
    return out[:n]


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_agrees_with_all_pairs(spark, frame):
    rows = list(enumerate(texts(350, 1))) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "One"), (1005, "one two"), (1006, "é" * 9)]
    assert got(ngram_join.groups(frame(rows).repartition(5))) == plain(rows)


def test_long_runs_are_settled_in_tiles(spark, frame, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "HOT", 0)
    tiled = []
    inner = ngram_join.tiles
    monkeypatch.setattr(ngram_join, "tiles", lambda *a: tiled.append(1) or inner(*a))
    # short texts that share most of a passage, and differ enough to make several groups
    r = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([*passage[r.randrange(3) : 30 - r.randrange(6)], *(f"x{r.randrange(4)}" for _ in range(r.randrange(7)))])) for i in range(80)]
    assert got(ngram_join.groups(frame(rows).repartition(3))) == plain(rows)
    assert tiled


def test_shared_shingles_are_counted_over_all_texts(spark, frame):
    r = random.Random(4)
    texts_ = [" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) + " " + " ".join(f"p{k}" for k in range(40)) for _ in range(30)]
    codes, counts, _ = ngram_join.shared_shingles(frame(list(enumerate(texts_))).repartition(6), 75, 30 * 76)
    assert len(codes) and set(counts.tolist()) == {30}


@pytest.mark.parametrize("percent", [75, 90])
def test_bounds_never_lose_a_link(percent):
    @settings(max_examples=200, deadline=None)
    @given(st.sets(st.integers(1, 2**63), min_size=1, max_size=80), st.sets(st.integers(1, 2**63), max_size=12), st.sets(st.integers(1, 2**63), max_size=12))
    def check(base, more, less):
        a = np.array(sorted(base | more), np.uint64)
        b = np.array(sorted((base - set(sorted(base)[: len(less)])) | less), np.uint64)
        if not len(b):
            return
        same, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert ngram_join.apart(ngram_join.bitmap(a), ngram_join.bitmap(b)) <= union - same
        if 100 * same >= percent * union:
            assert ngram_join.may_link(len(a), len(b), ngram_join.apart(ngram_join.bitmap(a), ngram_join.bitmap(b)), percent)
            both, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            hot = np.array(sorted(base)[::3], np.uint64)
            level = np.concatenate([[0], np.random.default_rng(0).permutation(len(hot)) + 1])
            taken = ngram_join.heads(both, at, level[C.Lookup(hot)(both)], percent)
            assert set(both[: len(a)][taken[: len(a)]].tolist()) & set(both[len(a) :][taken[len(a) :]].tolist())

    check()


@pytest.mark.parametrize("at_once", [1 << 20, 50])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 400)] + [(1000, k) for k in range(1001, 1300)] + [(7, 7)]
    label = {}
    for a, b in links * 400:
        if a != b:
            label[a] = label[b] = min(label.get(a, a), label.get(b, b))
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    found = {x.node: x.label for x in components.components(df).collect()}
    assert found == label
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_repeated_rows_null_ids_and_empty_tables(spark, frame):
    a, b = "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y zz"
    rows = ngram_join.groups(frame([(5, a), (5, a), (5, b), (None, b), (None, "alone here"), (3, "")])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows) == [(0, 1, 0), (0, 22, 5), (3, 0, 3), (5, 22, 5), (5, 22, 5), (5, 22, 5)]
    assert ngram_join.groups(frame([])).collect() == []
    df = frame(list(enumerate([a, b, "other words entirely", ""])))
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    odd = ngram_join.keep_one(frame([(5, a), (5, "z " + a), (3, b), (None, a), (None, "q r s"), (None, "q r  s"), (7, None), (8, "")]).withColumnRenamed("score", "_id").withColumnRenamed("bucket", "_key"))
    assert sorted((r.doc_id or 0, r.text or "") for r in odd.collect())[1:] == [(3, b), (7, ""), (8, "")] and odd.count() == 4


def test_regular_words_link_with_nothing(spark, frame):
    rows = []
    for n in (1024, 2048, 4096):
        x, y = "a", "b"
        while len(x) < n:
            x, y = x + y, y + x
        rows += [(len(rows), x), (len(rows) + 1, y), (len(rows) + 2, x + " " + y), (len(rows) + 3, y + " " + x)]
    assert got(ngram_join.groups(frame(rows))) == {i: (1, i) for i, _ in rows}
    from millrace.llm import fingerprints

    found = fingerprints.compare_edited(frame(rows)).collect()
    assert len({r.fingerprint for r in found}) == len(rows) and all(r.near_next < 1 for r in found)


@pytest.mark.parametrize("small, block", [(8, 1024), (2, 8)])
def test_every_link_is_counted(spark, frame, monkeypatch, small, block):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    near = [" ".join(base[:k] + [f"x{r.randrange(9)}"] + base[k + 1 :]) for k in (0, 1, 2, 30, 58, 59) for _ in range(12)]
    rows = list(enumerate(texts(150, 7) + near)) + [(1000, None), (1001, "")]
    sets, least = {i: frozenset(C.shingle_set(t)) for i, t in rows}, {}
    for i, s in sorted(sets.items()):
        least.setdefault(s, i)
    expected = {}
    ids = [i for i in sorted(sets) if sets[i]]
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                key = tuple(sorted((least[sets[i]], least[sets[j]])))
                expected[key] = expected.get(key, 0) + 1
    out = ngram_join.links(frame(rows).repartition(5)).collect()
    assert len(out) == len(expected) and {(x.a, x.b): x.n_links for x in out} == expected


def test_very_long_texts(spark, frame):
    r = random.Random(8)
    words = [f"w{r.randrange(10**6)}" for _ in range(120_000)]
    near = [*words[:100_000], *(f"v{r.randrange(10**6)}" for _ in range(8_000))]
    far = [*words[:60_000], *(f"u{r.randrange(10**6)}" for _ in range(60_000))]
    texts = [" ".join(words), " ".join(near), " ".join(far), "a short one of six words"]
    sets = [C.shingle_set(t) for t in texts]
    got = {x.doc_id: x for x in ngram_join.groups(frame(list(enumerate(texts)))).collect()}
    assert [got[i].n_shingles for i in range(4)] == [len(s) for s in sets]
    linked = [[100 * len(a & b) >= 75 * len(a | b) for b in sets] for a in sets]
    assert linked[0][1] and not linked[0][2]
    assert [got[i].component_id for i in range(4)] == [0, 0, 2, 3]
