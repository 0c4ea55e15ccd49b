import random
import zlib

import numpy as np
import pyarrow as pa

from millrace.llm import common as C
from millrace.llm import labelled as L
from millrace.llm import toxicity


def _texts(n, seed, bad=("idiot", "scum", "lowei"), longest=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(r.choice(["on", "the", "re", "ti", "an", "lo", "we"]) for _ in range(r.randrange(1, 4))) for _ in range(r.choice([5, 60, longest]))]
        if i % 4 == 0:
            for _ in range(3):
                w = r.choice(bad)
                words.insert(r.randrange(len(words) + 1), w + r.choice(["on", "ti", "re"]) if w == "lowei" else w.upper() if i % 8 else w)
        out.append((i, " ".join(words), int(i % 4 == 0)))
    return out


def test_held_out_rows_are_told_apart(spark, frame):
    rows = _texts(900, 1)
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    docs = frame([(i, t) for i, t, _ in rows] + [(2000, None), (2001, ""), (2002, "z" * 300_000), (2003, "the on " * 30_000 + "idiot scum")])
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert got[2000].score == got[2001].score and got[2003].predicted == 1
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if not r.predicted}


def test_scores_depend_on_the_text_only():
    rows = _texts(200, 2)
    net = toxicity.fit([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.float32), 0.25, rounds=1, epochs=1)
    texts = [t for _, t, _ in rows[:30]] + ["", "a"]
    together = net(*C.buffer_of(pa.array(texts)))
    alone = np.concatenate([net(*C.buffer_of(pa.array([t]))) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def test_every_word_is_in_a_window():
    at = np.concatenate([[0], np.cumsum([0, 1, 39, 40, 41, 70, 71, 500])])
    begin, length, first = toxicity.windows(at)
    for d in range(len(at) - 1):
        seen = set()
        for w in range(first[d], first[d + 1]):
            assert at[d] <= begin[w] and begin[w] + length[w] <= at[d + 1]
            seen |= set(range(begin[w], begin[w] + length[w]))
        assert seen == set(range(at[d], at[d + 1]))


def test_gradients_agree_with_differences():
    rows = _texts(40, 3, longest=80)
    net = toxicity.fit([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.float32), 0.25, rounds=1, epochs=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, offsets = C.buffer_of(pa.array([t for _, t, _ in rows]))
    hashes, at = C.word_hashes(data, offsets)
    begins, ends = C.words_of(data, offsets)
    kinds, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    codes, code_at = toxicity.features(data, begins[one], ends[one])
    word_of, char_of = net.words(kinds), net.chars(codes)
    begin, length, _ = toxicity.windows(at)
    begin, length = begin[:12], length[:12]
    place = np.minimum(begin[:, None] + np.arange(toxicity.WINDOW), len(which) - 1)
    inside = np.arange(toxicity.WINDOW) < length[:, None]
    y, weight = np.arange(12) % 2.0, np.ones(12)
    taken = {}

    class Keep:
        def step(self, grads):
            taken.update(grads)

    class All:
        def random(self, shape):
            return np.zeros(shape)

    def loss():
        x = np.hstack([net.p["word"][word_of], np.tanh(toxicity.sums(net.p["char"][char_of], code_at))]) @ net.p["in"] + net.p["in0"]
        given = np.where(inside[:, :, None], x[which[place]], 0)
        q = L.sigmoid(net.attend(net.read(given, inside), inside)[2].astype(np.float64))
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    toxicity._step(net, Keep(), which[place], inside, y, weight, word_of, char_of, code_at, All())
    r = np.random.default_rng(0)
    for name in ("out", "at", "re", "in", "in0", "out0"):
        flat = net.p[name].reshape(-1)
        for k in r.choice(flat.size, min(4, flat.size), replace=False):
            held = flat[k]
            flat[k] = held + 1e-2
            up = loss()
            flat[k] = held - 1e-2
            down = loss()
            flat[k] = held
            assert abs((up - down) / 2e-2 - taken[name].reshape(-1)[k]) < 2e-3, name


def test_no_labels_and_no_documents(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.classify(frame([(1, "a"), (None, None)]), none).collect()} == {0.5}
    assert toxicity.classify(frame([]), none).collect() == []


def _plain(net, text):
    """The score of one text by loops over its words and gates."""
    import math

    p, words = net.p, [w.encode() for w in C.fold_words(text)]
    if not words:
        return net.share
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    given = []
    for w in words:
        padded = b"\x01" + w + b"\x02"
        codes = [padded[i - 1] << 16 | padded[i] << 8 | padded[i + 1] for i in range(1, len(w) + 1)]
        first = (w + b"\x02" * 5)[:5]
        codes += [int.from_bytes(first[: k + 1], "big") | k << 40 for k in (3, 4)]
        char = np.tanh(sum(p["char"][net.chars(np.array([c]))[0]].astype(float) for c in codes))
        own = p["word"][net.words(C.hash_spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), fold=True))[0]]
        given.append(np.concatenate([own, char]) @ p["in"] + p["in0"])
    starts = [0]
    while starts[-1] + toxicity.WINDOW < len(words):
        starts.append(min(starts[-1] + toxicity.STRIDE, len(words) - toxicity.WINDOW))
    best, n = -math.inf, toxicity.STATE
    for start in starts:
        window = given[start : start + toxicity.WINDOW]
        states = np.zeros((len(window), 2 * n))
        for way, order in ((0, range(len(window))), (1, range(len(window) - 1, -1, -1))):
            h = np.zeros(n)
            for t in order:
                x, u = window[t][way * 3 * n : (way + 1) * 3 * n], h @ p["re"][way]
                z = np.array([sigmoid(v) for v in x[:n] + u[:n]])
                r = np.array([sigmoid(v) for v in x[n : 2 * n] + u[n : 2 * n]])
                h = (1 - z) * h + z * np.tanh(x[2 * n :] + r * u[2 * n :])
                states[t, way * n : (way + 1) * n] = h
        e = np.exp(states @ p["at"] - (states @ p["at"]).max())
        best = max(best, float((e / e.sum()) @ states @ p["out"] + p["out0"][0]))
    return sigmoid(best)


def test_scores_agree_with_loops_over_words():
    rows = _texts(200, 6, longest=120)
    net = toxicity.fit([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.float32), 0.25, rounds=2, epochs=2)
    texts = [" ".join(t.split()[:n]) for (_, t, _), n in zip(rows[:12], [0, 1, 2, 39, 40, 41, 69, 70, 71, 120, 120, 120], strict=True)] + ["a", "É ß"]
    assert np.allclose(net(*C.buffer_of(pa.array(texts))), [_plain(net, t) for t in texts], atol=1e-4)


def test_repeated_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = _texts(80, 3, longest=60)
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] * 2, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 2, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "label", "_toxicity", "toxic", "key")})
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 160 and len({(r.doc_id, r.score) for r in got}) == 80
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.predicted)
    assert {r["_toxicity"] for r in kept.collect()} == {"x"}


def test_long_texts_are_learnt_from(spark, frame):
    long = "on the " * 9000 + "idiot " * 50
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    texts, y, share = L.sample(frame([(i, long if i < 4 else "short text") for i in range(6)]), labels, "toxic", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(True))
    assert sorted(y.tolist()) == [0, 0, 0, 1, 1, 1] and share == 0.5
    assert sorted(map(len, texts)) == sorted([len(long)] * 4 + [10] * 2) and set(texts) == {long, "short text"}


def test_a_mark_deep_within_long_texts_is_learnt(spark, frame):
    # the only toxic words lie between places that a few evenly spread pieces would show
    draw = random.Random(9)
    filler = lambda n: " ".join(draw.choice(["rain", "moss", "bread", "stone", "lamp", "grey"]) for _ in range(n))
    rows = [(i, f"{filler(700)} vile rotten scum {filler(5500)}" if i % 3 == 0 else filler(6200), i % 3 == 0) for i in range(45)]
    labels = spark.createDataFrame([(i, 0, int(y)) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(frame([(i, t) for i, t, _ in rows]), labels).collect()}
    assert sum(got[i].predicted == y for i, _, y in rows if got[i].held_out) >= 0.9 * sum(r.held_out for r in got.values())
