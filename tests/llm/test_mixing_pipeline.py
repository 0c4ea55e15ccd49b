import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import common as C
from millrace.llm import mixing, tokens
from tests.llm.conftest import DOCS


def _rows(n=3000, seed=2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        source = "big" if r.random() < 0.6 else f"s{r.randrange(6)}"
        lang = r.choice(["en", "en", "en", "de", None])
        text = r.choice(["plain words here", "a | b", "number 7", "The License", "", None])
        out.append((i, text and text + " w" * r.randrange(60), lang, source, 0))
    return out


def _pieces(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path("piece_bpe_32k.model"))
    return [len(x) for x in model.encode([t or "" for t in texts])]


def _plain(rows, targets, temperature, sweeps=200):
    """Raking with dictionaries."""
    topic = lambda t: "legal" if "license" in t.lower() else "tabular" if " | " in t else "figures" if any(c in "0123456789" for c in t) else "prose"
    cells = defaultdict(int)
    for (_, t, lang, source, _), n in zip(rows, _pieces([t for _, t, *_ in rows]), strict=True):
        cells[source or "", lang or "", topic(t or "")] += n
    total = sum(cells.values())
    fit = {k: float(v) for k, v in cells.items()}
    goals = []
    for d, name in enumerate(mixing.DIMENSIONS):
        sums = defaultdict(float)
        for k, v in cells.items():
            sums[k[d]] += v
        goal = {k: (v / total) ** temperature for k, v in sums.items() if v}
        if name in targets:
            rest = {k: v for k, v in sums.items() if k not in targets[name] and v}
            goal = {k: targets[name].get(k, (1 - sum(targets[name].values())) * v / max(sum(rest.values()), 1)) for k, v in sums.items() if v}
        whole = sum(goal.values())
        goals.append({k: v / whole for k, v in goal.items()})
    for _ in range(sweeps):
        for d, goal in enumerate(goals):
            sums = defaultdict(float)
            for k, v in fit.items():
                sums[k[d]] += v
            fit = {k: v * goal.get(k[d], 0) * total / sums[k[d]] if sums[k[d]] else 0.0 for k, v in fit.items()}
    return {k: fit[k] / v if v else 1.0 for k, v in cells.items()}, goals


TARGETS = {"lang": {"de": 0.5, "fr": 0.2}, "topic": {"legal": 0.1}}


@pytest.mark.parametrize("targets, most, sweeps", [({}, 10_000, 200), (TARGETS, 10_000, 200), (TARGETS, 3, 2)])
def test_weights_agree_with_plain_raking(spark, targets, most, sweeps):
    rows = _rows()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    expected, goals = _plain(rows, targets, mixing.TEMPERATURE, sweeps)
    table, few = mixing.weights(mixing.measured(df, None), targets=targets, most=most, sweeps=sweeps)
    assert few == (most > 3)
    got = {(r[0], r[1], r[2]): r["weight"] for r in table.collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 2e-3 * max(1, expected[k]) for k in got)


def test_the_sample_has_the_target_shares(spark):
    rows = _rows(20_000)
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    kept = Counter()
    for r in out:
        assert 0 <= r.probability <= 1
        if r.sampled:
            kept[r.source] += r.n_tokens
    _, goals = _plain(rows, {}, mixing.TEMPERATURE)
    total = sum(kept.values())
    assert total > 0.4 * sum(r.n_tokens for r in out)
    assert all(abs(kept[k] / total - v) < 0.02 for k, v in goals[0].items())


def test_a_scarce_source_reaches_its_target(spark):
    rows = [(i, "w " * 10, "en", "rare" if i < 80 else "big", 0) for i in range(10_000)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(5), targets={"source": {"big": 0.8, "rare": 0.2}}).collect()
    expected = Counter()
    for r in out:
        expected[r.source] += r.n_tokens * r.probability
    assert np.isclose(expected["rare"] / sum(expected.values()), 0.2, rtol=1e-6)
    assert all(r.sampled for r in out if r.source == "rare" and r.probability == 1) and 0.1 < sum(r.n_tokens for r in out if r.source == "rare" and r.sampled) / sum(r.n_tokens for r in out if r.sampled) < 0.3


def test_mixing_of_odd_tables(spark, frame):
    assert mixing.mix(frame([])).collect() == []
    got = mixing.mix(frame([(1, None), (1, None), (None, ""), (None, "")])).collect()
    assert len(got) == 4 and all(r.weight == 1 for r in got)
    long = mixing.mix(frame([(1, "w " * 100_000), (2, "w")])).collect()
    assert {r.doc_id: r.n_tokens for r in long} == {1: _pieces(["w " * 100_000])[0], 2: 1}
    df = frame([(1, "a"), (2, "b")])
    assert mixing.sample(df).columns == df.columns
    own = {r.topic for r in mixing.mix(df, topic=df["bucket"]).collect()}
    assert own == {"x"}


def test_clashing_columns_are_passed_on(spark, frame):
    from pyspark.sql import functions as F

    names = ("_source", "_topic", "_probability", "_SOURCE", "topic", "weight", "n_tokens", "row", "pretoken")
    df = frame([(i, f"word {i} here") for i in range(50)]).withColumns({n: F.lit(n) for n in names if n != "_SOURCE"})
    out = mixing.sample(df)
    assert out.columns == df.columns and all(r[n] == n for r in out.collect() for n in names if n != "_SOURCE")
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in mixing.mix(df).collect() if r.sampled}


def test_pipeline_stages_do_what_they_say(spark, frame, tmp_path):
    r = random.Random(4)
    rows = []
    for i in range(400):
        words = ["".join(r.choice(["on", "the", "re", "ti", "an"]) for _ in range(r.randrange(1, 4))) for _ in range(r.choice([8, 40, 200]))]
        if i % 5 == 0:
            words[r.randrange(len(words))] = words[0] = "scum"
        rows.append([i, " ".join(words), "en", f"s{i % 3}", 0])
    for i in range(400, 480):
        text = rows[i - 399][1]
        rows.append([i, text if i % 2 else text + " tail", "en", "s0", 0])
    folder = str(tmp_path / "in")
    spark.createDataFrame([tuple(x) for x in rows], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = C.load(spark, folder, "documents")
    bad = {i for i, t, *_ in rows if "scum" in t.split()}
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({x.doc_id for x in docs.collect()})
    text = {i: t for i, t, *_ in rows}
    assert len(kept[0] & bad) <= 0.1 * len(bad) and len(set(text) - bad - kept[0]) <= 0.02 * len(text)
    last = {}
    for i in sorted(kept[0]):
        last[text[i]] = i
    assert kept[1] == set(last.values())
    from tests.llm.test_ngram_join import plain

    assert kept[2] == {i for i, (_, c) in plain([(i, text[i]) for i in kept[1]]).items() if i == c}
    assert kept[3] < kept[2] and len(kept[3]) > 0.5 * len(kept[2]) and kept[4] == kept[3]
    assert corpus_pipeline.run(spark, folder).count() == docs.count()
    assert np.isclose(docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0], 1024, atol=400)


def test_pipeline_of_odd_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    names = ("_source", "_topic", "_toxicity", "_digest", "_keep", "_id", "_key", "score", "bucket", "row", "topic", "n_tokens", "probability")
    odd = [(None, None, None, None, None), (None, "a", "en", "s", 1), (1, "", None, "s", 0), (1, None, "en", None, 0), (2, "same words here", "en", "s", 0), (3, "same words here", "en", "s", 0), (3, "same words here", "en", "s", 0), (4, "w " * 40_000, "en", "s", 0)]
    for k, rows in enumerate(([], odd)):
        folder = str(tmp_path / str(k))
        docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(n) for n in names})
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        own = C.load(spark, folder, "documents")
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, own, folder)
            assert out.columns == docs.columns and all(r[n] == n for r in out.collect() for n in names)
        out = corpus_pipeline.run(spark, folder)
        assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and (out.count() > 0) == bool(rows)
        copies = [(x.doc_id, x.text) for x in corpus_pipeline.drop_copies(spark, own, folder).collect()]
        assert len(copies) == (4 if rows else 0)
