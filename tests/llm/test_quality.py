import random
import zlib

import numpy as np

from millrace.llm import quality


def _texts(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(r.choice(["on", "the", "re", "ti", "an"]) for _ in range(r.randrange(1, 4))) for _ in range(r.choice([5, 60, 900]))]
        good = i % 3 > 0
        if not good:
            words = [[w.upper() + "!!" for w in words], [x for w in words for x in [w] * 7], [w + "###" for w in words]][i // 3 % 3]
        out.append((i, " ".join(words), int(good)))
    return out


def test_held_out_rows_are_told_apart(spark, frame):
    rows = _texts(600, 1)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(frame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "z" * 300_000)]), labels).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert got[1000].score == got[1001].score


def test_scores_depend_on_the_text_only_and_cover_it_all():
    rows = _texts(300, 2)
    import pyarrow as pa

    from millrace.llm import common as C

    net = quality.fit([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.float32), 0.6)
    texts = [t for _, t, _ in rows[:40]] + [""]
    together = net(*C.buffer_of(pa.array(texts)))
    alone = np.concatenate([net(*C.buffer_of(pa.array([t]))) for t in texts])
    assert np.allclose(together, alone, atol=1e-6)
    clean = " ".join(["therean tion ontire an"] * 4000)
    spoilt = clean + " " + " ".join(["ONTHE!!"] * 12000)
    a, b = net(*C.buffer_of(pa.array([clean, spoilt])))
    assert b < a


def test_no_labels_and_no_documents(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(frame([(1, "a"), (None, None)]), none).collect()} == {0.5}
    assert quality.classify(frame([]), none).collect() == []


def _plain(net, text):
    """The score of one text by loops over its bytes."""
    data = [*(text or "").encode(), *[0] * quality.PAD]
    p, size, chunk, stride = net.p, quality.SEGMENT, quality.PER_CHUNK, quality.STRIDE
    cells = range(-(-len(data) // size))
    starts = [0]
    while starts[-1] + chunk < len(cells):
        starts.append(starts[-1] + stride)
    logits = []
    for start in starts:
        strongest = np.zeros(quality.FILTERS)
        for i in range(start * size, min((start + chunk) * size, len(data) - quality.WIDTH + 1)):
            strongest = np.maximum(strongest, sum(p["filters"][k][data[i + k]] for k in range(quality.WIDTH)))
        logits.append(np.clip(np.tanh(strongest @ p["a"] + p["a0"]) @ p["b"] + p["b0"][0], -8, 8))
    x = np.array([np.mean(logits), min(logits), max(logits), 1.0]) @ p["doc"]
    return 1 / (1 + np.exp(-x))


def test_scores_agree_with_loops_over_the_bytes():
    import pyarrow as pa

    from millrace.llm import common as C

    rows = _texts(200, 4)
    net = quality.fit([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.float32), 0.6)
    texts = [t[:n] for (_, t, _), n in zip(rows, [0, 1, 3, 119, 120, 121, 127, 128, 129, 500, 504, 505, 600, 1500, 4000, 9000], strict=False)] + ["é" * 333]
    assert np.allclose(net(*C.buffer_of(pa.array(texts))), [_plain(net, t) for t in texts], atol=1e-4)


def test_repeated_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = _texts(60, 3)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] * 2, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 2, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "label", "held_out", "predicted", "quality")})
    got = quality.classify(docs, labels).collect()
    assert len(got) == 120 and len({(r.doc_id, r.score) for r in got}) == 60


def test_every_chunk_is_learnt_from(monkeypatch):
    rows = _texts(40, 5)
    texts = [t + " and so on" * 900 * (k % 9 == 0) for k, (_, t, _) in enumerate(rows)]
    seen, real = [], quality._epoch
    monkeypatch.setattr(quality, "_epoch", lambda p, adam, drawn, *rest: (seen.append((adam.rate, drawn.copy())), real(p, adam, drawn, *rest))[1])
    quality.fit(texts, np.array([y for _, _, y in rows], np.float32), 0.6, epochs=4)
    import pyarrow as pa

    from millrace.llm import common as C

    _, first = quality.segments(quality.padded(*C.buffer_of(pa.array(texts)))[1])
    total = quality.chunks(first)[2][-1]
    for rate in {r for r, _ in seen}:
        assert set(np.concatenate([d for r, d in seen if r == rate]).tolist()) == set(range(total))
