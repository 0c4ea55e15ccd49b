import time

import numpy as np
import pandas as pd
import pytest

from millrace.operators import alignment, features, scaling, sensory
from millrace.sources import tables
from millrace.streaming import adaptive


def test_warping_undoes_a_delay():
    t = np.linspace(0, 6, 60)
    reference = np.column_stack([np.sin(t), t])
    slow = np.repeat(reference, 2, axis=0)
    rows, distance = alignment.warped(slow, reference, np.ones(2))
    assert np.allclose(rows, reference) and distance < 1e-12
    plain = np.full((5, 4), np.inf)
    x, y = np.random.default_rng(0).normal(size=(5, 1)), np.random.default_rng(1).normal(size=(4, 1))
    for i in range(5):
        for j in range(4):
            before = [plain[i - 1, j - 1] if i and j else np.inf, plain[i - 1, j] if i else np.inf, plain[i, j - 1] if j else np.inf]
            plain[i, j] = (x[i, 0] - y[j, 0]) ** 2 + (0 if i == j == 0 else min(before))
    assert np.allclose(plain, alignment.distances(x, y, np.ones(1)))


def _aligned(batches, own, most=25, tolerance=0.1):
    """Every step of the alignment on the driver, cell by cell."""
    keys = sorted(batches)
    spans = np.array([np.quantile(batches[k], 0.98, axis=0) - np.quantile(batches[k], 0.02, axis=0) for k in keys])
    span, least = np.median(np.where(spans == 0, 1, spans), axis=0), np.median([batches[k].min(0) for k in keys], axis=0)
    scaled = {k: (batches[k] - least) / span for k in keys}

    def warp(test, ref, w):
        n, m = len(test), len(ref)
        local = [[float((w * (test[i] - ref[j]) ** 2).sum()) for j in range(m)] for i in range(n)]
        total = [[np.inf] * m for _ in range(n)]
        for i in range(n):
            for j in range(m):
                before = min([total[i - 1][j - 1] if i and j else np.inf, total[i - 1][j] if i else np.inf, total[i][j - 1] if j else np.inf]) if i or j else 0.0
                total[i][j] = local[i][j] + before
        i, j, steps = n - 1, m - 1, [(n - 1, m - 1)]
        while i or j:
            options = [(a, b) for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if a >= 0 and b >= 0]
            i, j = min(options, key=lambda p: total[p[0]][p[1]])
            steps.append((i, j))
        return np.array([np.mean([test[a] for a, b in steps if b == c], axis=0) for c in range(m)])

    average = ref = scaled[own]
    weights, turn = np.ones(2), 0
    moved = np.inf
    while moved > tolerance and turn <= most:
        turn += 1
        out = {k: warp(scaled[k], average if turn > 3 else ref, weights) for k in keys}
        average = np.mean(list(out.values()), axis=0)
        spread = sum(((v - average) ** 2).sum(0) for v in out.values())
        new = 1 / spread
        new = new / new.sum() * 2
        moved, weights = np.linalg.norm(new - weights), new
    return {k: alignment.cubic(v * span + least, 100) for k, v in out.items()}, weights, turn


def test_alignment_of_batches(spark):
    r = np.random.default_rng(2)
    batches = {}
    for k, n in enumerate((14, 11, 17, 14, 20, 9)):
        t = np.linspace(0, 1, n) ** r.uniform(0.6, 1.5)
        batches[k] = np.column_stack([5 * np.sin(3 * t) + 0.2 * r.normal(size=n), 100 * t + 30 * r.normal(size=n)])
    df = spark.createDataFrame([(k, i, float(a), float(b)) for k, v in batches.items() for i, (a, b) in enumerate(v)] + [(0, 99, None, 1.0)], "b long, i int, x double, y double").repartition(3)
    for tolerance in (0.1, 1e-6):
        out, weights = alignment.batch_dtw(df, "b", "i", ["x", "y"], reference=3, most=6, tolerance=tolerance)
        want, plain_weights, turns = _aligned(batches, 3, most=6, tolerance=tolerance)
        got = out.toPandas().sort_values(["b", "position"])
        assert np.allclose(weights, plain_weights) and (tolerance == 0.1 or turns > 4)
        for k in batches:
            own = got[got["b"] == k]
            assert own["position"].tolist() == list(range(100)) and np.allclose(own[["x", "y"]], want[k], atol=1e-6)
    with pytest.raises(ValueError):
        alignment.batch_dtw(df, "b", "i", ["x", "y"], reference=77)
    with pytest.raises(ValueError):
        alignment.batch_dtw(df, "b", "i", ["x", "y"], most=2)
    two = alignment.resample(spark.createDataFrame([(1, 0, 0.0), (1, 1, 10.0), (2, 0, 5.0)], "b int, k int, x double"), "b", "k", ["x"], 5).toPandas()
    assert two[two["b"] == 1].sort_values("position")["x"].tolist() == [0, 2.5, 5, 7.5, 10] and two[two["b"] == 2]["x"].tolist() == [5.0] * 5


def test_many_batches_are_warped_at_once_as_one_by_one():
    r = np.random.default_rng(5)
    for m, most in ((1, 26), (2, 26), (4, 26), (9, 26), (9, 400), (9, 5000), (9, alignment.MOVES), (40, 3000)):
        lengths = r.integers(1, 14, size=25)
        lengths[:4] = 13, 1, 2, 13
        test, reference, weights = r.integers(0, 4, size=(2, 13, 25)).astype(float), r.integers(0, 4, size=(m, 2)).astype(float), np.array([0.5, 2.0])
        rows, distance = alignment.warped_all(test, lengths, reference, weights, most)
        for b, n in enumerate(lengths):
            own, far = alignment.warped(test[:, :n, b].T, reference, weights)  # whole numbers: many ties
            assert (rows[:, :, b].T == own).all() and distance[b] == far
    long, short = r.normal(size=(1, 3000, 1)), r.normal(size=(20, 1))
    rows, distance = alignment.warped_all(long, np.array([3000]), short, np.ones(1), 2000)
    own, far = alignment.warped(long[:, :, 0].T, short, np.ones(1))
    assert np.allclose(rows[:, :, 0].T, own) and np.isclose(distance[0], far)


def test_alignment_of_many_batches_takes_no_python_call_each(spark):
    r = np.random.default_rng(6)
    values = [[(k, i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(30 + k % 7, 2)))] for k in range(300)]
    df = spark.createDataFrame([row for rows in values for row in rows], "b long, i int, x double, y double").repartition(3)
    out, _ = alignment.batch_dtw(df, "b", "i", ["x", "y"], reference=4)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    assert out.count() == 30000 and out.select("b").distinct().count() == 300
    batches = np.stack([np.array(rows)[:30, 2:] for rows in values])
    began = time.process_time()
    one = np.stack([alignment.warped(x, batches[0], np.ones(2))[0] for x in batches], axis=2)
    middle = time.process_time()
    rows, _ = alignment.warped_all(np.ascontiguousarray(batches.T), np.full(300, 30), batches[0], np.ones(2))
    assert np.allclose(rows, one.transpose(1, 0, 2)) and 4 * (time.process_time() - middle) < middle - began


def test_ranges_of_gathered_batches(spark):
    r = np.random.default_rng(7)
    rows = [(k, i, float(a), float(b)) for k in range(9) for i, (a, b) in enumerate(r.normal(size=(1 + 7 * k, 2)))] + [(10, 3, 1.0, None), (10, 2, 1.0, 5.0), (10, 1, 1.0, 7.0), (10, 0, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "b long, i int, x double, y double").repartition(3)
    packed = alignment.gathered(df, "b", "i", ["x", "y"])
    assert [tuple(x) for x in packed.filter("b = 10").collect()] == [(10, [1.0, 1.0], [7.0, 5.0])]
    for robust in (True, False):
        want = {x["tag"]: x[1:] for x in scaling.batch_ranges(df.dropna(), "b", ["x", "y"], robust).collect()}
        got = {x["tag"]: x[1:] for x in scaling.ranges_of_arrays(packed, ["x", "y"], robust).collect()}
        assert sorted(got) == sorted(want) == ["x", "y"] and all(np.allclose(got[t], want[t], rtol=1e-14) for t in want)


def _central(batches, limits):
    """The batch nearest the centre, on the driver; limits: the model's T2 and SPE limits of (rows, components, ...)."""
    length = sorted(len(b) for b in batches.values())[len(batches) // 2]
    wide = pd.DataFrame({k: alignment.cubic(b, length).T.ravel() for k, b in batches.items()}).T

    def fit(x):
        z = (x - x.mean()) / x.std()
        u, d, v = np.linalg.svd(z.to_numpy(), full_matrices=False)
        t2 = (u[:, :4] ** 2).sum(axis=1) * (len(x) - 1)
        q = ((z.to_numpy() - (u[:, :4] * d[:4]) @ v[:4]) ** 2).sum(axis=1)
        return t2, q

    t2, _ = fit(wide)
    kept = wide[t2 < limits.t2_limit(len(wide), 4, 0.9)]
    t2, q = fit(kept)
    good = np.sqrt(q) < limits.spe_limit_of(q.mean(), q.var(ddof=1), 0.5)
    return kept.index[good][t2[good].argmin()]


def test_reference_batch_is_the_most_central_one(spark):
    from millrace.operators import latent

    x = np.array([0.0, 1, 2, 5, 3, 8])
    assert np.allclose(alignment.cubic(x[:, None], 6)[:, 0], x) and np.allclose(alignment.cubic((np.arange(7.0) ** 3)[:, None], 13)[:, 0], np.linspace(0, 6, 13) ** 3)
    for seed in range(2):
        r = np.random.default_rng(seed)
        batches = {}
        for k in range(25):
            t = np.linspace(0, 3, 8 + k % 5)
            batches[k] = np.column_stack([np.sin(t) * (1 + 0.3 * r.normal()), t + r.normal()]) + 0.1 * r.normal(size=(len(t), 2))
        batches[2] = batches[2] + 30  # of median length, and far from all others
        df = spark.createDataFrame([(k, i, float(a), float(b)) for k, rows in batches.items() for i, (a, b) in enumerate(rows)], "b long, i int, x double, y double").repartition(3)
        assert alignment.find_average_length(df, "b") == 2
        assert alignment.find_reference_batch(df, "b", "i", ["x", "y"]) == _central(batches, latent)


def test_adaptive_model_tells_a_jump():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 1)) @ np.ones((1, 3)) + 0.1 * r.normal(size=(400, 3))
    model = adaptive.AdaptivePCA(x[:200], 1)
    inside = [model.update(v)[3] for v in x[200:]]
    assert np.mean(inside) > 0.8
    before = model.center.copy()
    assert not model.update(np.array([5.0, -5.0, 5.0]))[3] and (model.center == before).all()


def test_adaptive_prediction_follows_a_drift():
    r = np.random.default_rng(3)
    x = r.normal(size=(900, 1)) @ np.ones((1, 3)) + 0.3 * r.normal(size=(900, 3))
    slope = np.concatenate([np.full(300, 1.0), np.linspace(1, 2, 600)])
    y = slope * x.sum(axis=1) + 0.1 * r.normal(size=900)
    model = adaptive.AdaptivePLS(x[:300], y[:300], 2, memory=0.97)
    moving, still = [], []
    for row, v in zip(x[300:], y[300:], strict=True):
        parts = model.decompose(row)
        assert np.isclose(sum(parts.values()), model.predict(row))
        still.append(parts["static"] - v)
        moving.append(model.update(row, v)[0] - v)
    assert np.std(moving[300:]) < 0.6 * np.std(still[300:])
    assert adaptive.subspace_distance(np.eye(3)[:, :1], np.eye(3)[:, 1:2]) == 1.0


def test_stream_of_files(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = pd.DataFrame({"k": ["a", "b"] * 60, "t": np.arange(120), "x": r.normal(size=120), "y": r.normal(size=120)})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k string, t long, x double, y double").parquet(str(tmp_path / "in"))
    query = adaptive.adaptive_pca(source, "k", "t", ["x", "y"], 1).writeStream.format("memory").queryName("adaptive_test").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.table("adaptive_test").toPandas()
    assert len(out) == 120 and out["in_control"].notna().sum() == 60


def test_features_of_a_small_batch(spark):
    df = spark.createDataFrame([("b", 0.0, 1.0), ("b", 1.0, 3.0), ("b", 2.0, None), ("b", 3.0, 3.0), ("c", 0.0, 5.0)], "batch string, age double, x double")
    got = {r["batch"]: r for r in features.features(df, ["x"], ["batch"], "age").collect()}
    assert (got["b"]["x_mean"], got["b"]["x_count"], got["b"]["x_agemax"], got["b"]["x_last"], got["b"]["x_iqr"]) == (pytest.approx(7 / 3), 3, 1.0, 3.0, None)
    assert features.area(df, "x", "age", ["batch"]).filter("batch = 'b'").first()["x_area"] is None
    cross = features.crossings(df.dropna(), "x", "age", ["batch"], 2.0).collect()
    assert [(r["at"], r["direction"]) for r in cross] == [(0.5, "rising")]
    with pytest.raises(ValueError, match="missing"):
        features.check_batches(df, "batch", ["x"], no_nulls=True)


def test_widening_keeps_all_positions(spark):
    df = spark.createDataFrame([("b", 1, 2.0), ("b", 7, 3.0), ("c", 4, 5.0), ("c", 4, 6.0)], "batch string, k int, x double")
    got = features.widen(df, "batch", "k", ["x"])
    assert got.columns == ["batch", "1_x", "4_x", "7_x"]
    assert sorted(tuple(r) for r in got.collect()) == [("b", 2.0, None, 3.0), ("c", None, 6.0, None)]


def test_widening_deals_more_rows_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(features, "TASK_ROWS", 25, raising=False)
    rows = [(None if b == 3 else b, k, float(b * k), None if k == 2 else float(k)) for b in range(100) for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "batch long, k int, x double, y double")
    got = features.widen(df, "batch", "k", ["x", "y"], [1, 2, 4])
    assert got.columns == ["batch", "1_x", "1_y", "2_x", "2_y", "4_x", "4_y"]
    assert got.rdd.getNumPartitions() == 12
    assert {tuple(r) for r in got.collect()} == {(None if b == 3 else b, 1.0 * b, 1.0, 2.0 * b, None, None, None) for b in range(100)} and got.count() == 100


def test_panel(spark):
    rows = [(p, 1, f"prod{j}", "sweet", r, float(j + p * 0.1 + 0.01 * r)) for p in range(4) for j in range(3) for r in range(2)]
    panel = spark.createDataFrame([(f" p{p} ", *x) for p, *x in rows], "panelist_id string, session int, product string, attribute string, replicate int, score double")
    ok = sensory.validate(panel, low=0, high=10)
    assert ok["ok"] and ok["content_hash"] == sensory.validate(panel.repartition(7), low=0, high=10)["content_hash"]
    assert not sensory.validate(panel, low=0, high=1)["ok"]
    card = sensory.scorecard(sensory.clean(panel)).toPandas()
    assert (card["discrimination"] > 0.99).all() and (card["agreement"] > 0.99).all()
    aligned = sensory.align_scores(sensory.clean(panel)).groupBy("panelist_id").avg("aligned").toPandas()
    assert np.ptp(aligned["avg(aligned)"]) < 1e-9
    wide = sensory.reshape_to_long(spark.createDataFrame([("a", 1.0, 2.0)], "panelist_id string, sweet double, sour double").selectExpr("panelist_id", "'x' AS product", "sweet", "sour"), "wide_by_attribute", ["panelist_id", "product"], ["sweet", "sour"])
    assert wide.count() == 2


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1.5,NaN\n2.5,3\n")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"), "x double, y double")
    assert [tuple(r) for r in df.orderBy("x").collect()] == [(1.5, None), (2.5, 3.0)]
    assert sorted(r["value"] for r in tables.as_json(df).collect()) == ['{"x":1.5}', '{"x":2.5,"y":3.0}']
    tables.write_partitioned(df, str(tmp_path / "out"), ["x"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_rows_of_a_key_come_in_order_and_in_blocks():
    r = np.random.default_rng(11)
    rows = pd.DataFrame({"t": pd.to_datetime(r.integers(0, 40, 95), unit="s"), "x": r.normal(size=95), "y": r.normal(size=95)})
    rows.loc[3, "x"] = None
    got = list(adaptive.in_order((rows[i : i + 10] for i in range(0, 95, 10)), "t", ["x", "y"], 20))
    assert [len(t) for t, _ in got] == [20, 20, 20, 20, 15]
    want = rows.sort_values("t", kind="stable")
    assert pd.concat([t for t, _ in got]).tolist() == want["t"].tolist()
    assert np.array_equal(np.concatenate([x for _, x in got]), want[["x", "y"]].to_numpy(), equal_nan=True)
