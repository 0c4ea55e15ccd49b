import math

import numpy as np
import pytest

from millrace.functions import distributions as D
from millrace.operators import latent, linear, monitoring, robust, scaling, univariate


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    t = r.normal(size=(300, 2))
    x = t @ r.normal(size=(2, 5)) + 0.1 * r.normal(size=(300, 5)) + [1, 2, 3, 4, 5]
    y = x @ [1, -2, 0, 1, 0.5] + 0.2 * r.normal(size=300)
    names = [f"x{i}" for i in range(5)] + ["y"]
    m = np.column_stack([x, y])
    return names, m, spark.createDataFrame([tuple(map(float, v)) for v in m], ", ".join(f"{n} double" for n in names)).repartition(5)


def test_gram_by_aggregate_and_by_blocks(data, monkeypatch):
    names, m, df = data
    for limit in (24, 2):
        monkeypatch.setattr(linear, "PLAIN_COLUMNS", limit)
        n, sums, products = linear.gram(df, names)
        assert n == 300 and np.allclose(sums, m.sum(0)) and np.allclose(products, m.T @ m)


def test_ols_agrees_with_lstsq(data):
    names, m, df = data
    fit = linear.OLS.fit(df, "y", names[:3])
    a = np.column_stack([np.ones(300), m[:, :3]])
    beta, rss = np.linalg.lstsq(a, m[:, 5], rcond=None)[:2]
    assert np.allclose(fit.beta, beta) and math.isclose(fit.rss, rss[0], rel_tol=1e-8)
    s = fit.summary()
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * rss[0] / 296)
    assert np.allclose(s["standard_errors"], se) and s["dof"] == 296
    rows = fit.residuals(df).toPandas()
    assert abs(rows["residual"].sum()) < 1e-8 and math.isclose(rows["leverage"].sum(), 4, rel_tol=1e-8)
    wide = fit.prediction_interval(df).filter("y between pi_low and pi_high").count()
    assert 0.9 < wide / 300 <= 1


def test_formulas_are_columns_and_products_only(spark):
    y, terms = linear.terms_of("y ~ a*b + I(a**2)", ["y", "a", "b"])
    assert y == "y" and terms == [("a",), ("b",), ("a", "a"), ("a", "b")]
    for bad in ("y ~ __import__('os')", "y ~ a.b", "y ~ z", "q ~ a", "a", "y ~ a if b else a", "y ~ I(a**9)"):
        with pytest.raises(linear.UnsafeFormulaError):
            linear.terms_of(bad, ["y", "a", "b"])
    rows = [(a, b, 3 + 2.0 * a - b + 0.5 * a * b) for a in (-1.0, 1.0) for b in (-1.0, 1.0)] + [(0.0, 0.0, 3.1)]
    fit = linear.lm(spark.createDataFrame(rows, "A double, B double, y double"), "y ~ A*B")
    assert np.allclose(dict(zip(fit.names, fit.beta, strict=True))["A"], 2)
    half = spark.createDataFrame([(a, b, a * b, a + b) for a in (-1.0, 1.0) for b in (-1.0, 1.0)], "A double, B double, C double, y double")
    assert "A:B" in linear.lm(half, "y ~ A + B + C + A:B").aliased


def test_pca_scores_limits_and_contributions(data):
    names, m, df = data
    df = scaling.Scaler.fit(df, names[:5]).transform(df)
    x = (m[:, :5] - m[:, :5].mean(0)) / m[:, :5].std(0, ddof=1)
    fit = latent.PCA.fit(df, names[:5], 2)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(fit.loadings.T @ vt[:2].T), np.eye(2), atol=1e-8)
    assert np.isclose(fit.r2_cumulative[1], (s[:2] ** 2).sum() / (s**2).sum())
    rows = fit.diagnose(df).toPandas()
    assert np.isclose(rows["hotellings_t2"].sum(), 2 * 299, rtol=1e-8)
    residual = x - x @ vt[:2].T @ vt[:2]
    assert np.isclose((rows["spe"] ** 2).sum(), (residual**2).sum())
    assert (fit.loadings[np.abs(fit.loadings).argmax(0), [0, 1]] > 0).all()
    parts = fit.t2_contributions(df).toPandas()[[f"{c}_t2" for c in names[:5]]].sum(axis=1)
    assert np.isclose(parts.sum(), rows["hotellings_t2"].sum())
    assert 0.9 < fit.diagnose(df).filter(f"hotellings_t2 < {fit.t2_limit(0.95)}").count() / 300 <= 1
    assert 0.88 < fit.diagnose(df).filter(f"spe < {fit.spe_limit(0.95)}").count() / 300 <= 1
    same = latent.fit_missing(df, names[:5], 2)
    assert np.allclose(same.loadings, fit.loadings, atol=1e-4)


def test_t2_limit_is_the_f_limit_of_new_rows():
    # 54 rows, six components: 15.2017 and 21.2239 times (N + 1) / N
    assert abs(latent.t2_limit(54, 6, 0.95) * 54 / 55 - 15.2017) < 1e-3 and abs(latent.t2_limit(54, 6, 0.99) * 54 / 55 - 21.2239) < 1e-3


def test_pls_agrees_with_nipals(data):
    names, m, df = data
    fit = latent.PLS.fit(df, names[:5], ["y"], 3)
    z = (m - m.mean(0)) / m.std(0, ddof=1)
    x, y = z[:, :5].copy(), z[:, 5].copy()
    for a in range(3):
        w = x.T @ y
        w /= np.linalg.norm(w)
        t = x @ w
        p, q = x.T @ t / (t @ t), y @ t / (t @ t)
        x -= np.outer(t, p)
        y -= q * t
        assert np.allclose(np.abs(w @ fit.weights[:, a]), 1) and np.isclose(abs(fit.y_loadings[0, a]), abs(q))
    got = fit.predict(df).toPandas()
    expected = (z[:, 5] - y) * m[:, 5].std(ddof=1) + m[:, 5].mean()
    assert np.isclose(((got["y_hat"] - got["y"]) ** 2).sum(), ((expected - m[:, 5]) ** 2).sum())
    assert np.isclose((fit.vip() ** 2).sum(), 5)
    found, null = fit.invert([float(m[:, 5].mean())])
    assert np.isclose((found - fit.center[:5]) @ fit.beta[:, 0], 0, atol=1e-8) and null.shape == (3, 2)
    sizes = latent.select_components(df, names[:5], ["y"], 4)
    assert sizes[0]["rmsecv"] > sizes[3]["rmsecv"] and sizes[3]["q2"] > 0.9
    one = latent.OPLS.fit(df, names[:5], "y", 2).transform(df).toPandas()
    assert np.isclose(np.corrcoef(one["y_hat"], got["y_hat"])[0, 1], 1, atol=1e-6)


def test_multi_block(data):
    names, _, df = data
    blocks = {"a": names[:2], "b": names[2:5]}
    model = latent.MultiBlock.fit(df, blocks, 2)
    out = model.diagnose(df).toPandas()
    for a in (1, 2):  # a super score is the block scores by the super weights
        own = model.super_weights()[:, a - 1]
        assert np.allclose(own[0] * out[f"a_t{a}"] + own[1] * out[f"b_t{a}"], out[f"super_t{a}"])
    assert list(model.transform(df).toPandas().columns)[-2:] == ["super_t1", "super_t2"]
    assert 0 <= latent.rv_coefficient(df, names[:2], names[2:5]) <= 1
    assert math.isclose(latent.rv_coefficient(df, names[:2], names[:2]), 1)


def test_robust_lines():
    r = np.random.default_rng(0)
    x = np.arange(60.0)
    y = 3 + 2 * x + r.normal(size=60)
    y[::5] += 100
    assert abs(robust.repeated_median_slope_of(x, y) - 2) < 0.05
    assert abs(robust.huber_line(x, y)[1] - 2) < 0.1
    bend = np.where(x < 30, x, 30 + 0.1 * (x - 30))
    assert abs(robust.elbow_of(x, bend) - 30) < 3
    assert robust.line_intersection(1, 0, -1, 4) == (2.0, 2.0)


def test_esd_of_rosners_example():
    # fixed values: Rosner's 54 values, of which three are outliers
    x = np.array([-0.25, 0.68, 0.94, 1.15, 1.20, 1.26, 1.26, 1.34, 1.38, 1.43, 1.49, 1.49, 1.55, 1.56, 1.58, 1.65, 1.69, 1.70, 1.76, 1.77, 1.81, 1.91, 1.94, 1.96, 1.99, 2.06, 2.09, 2.10, 2.14, 2.15, 2.23, 2.24, 2.26, 2.35, 2.37, 2.40, 2.47, 2.54, 2.62, 2.64, 2.90, 2.92, 2.92, 2.93, 3.21, 3.26, 3.30, 3.59, 3.68, 4.30, 4.64, 5.34, 5.42, 6.01])
    found = univariate.esd_of(x, 10)
    assert sum(o for *_, o in found) == 3 and abs(found[0][1] - 3.118) < 0.002 and abs(found[0][2] - 3.158) < 0.002


def test_holt_winters_flags_a_jump(spark):
    r = np.random.default_rng(1)
    y = 10 + 0.05 * np.arange(120) + r.normal(size=120)
    y[90] += 30
    rows = [("a", i, float(v)) for i, v in enumerate(y)] + [("b", 0, 1.0)]
    got = monitoring.holt_winters_chart(spark.createDataFrame(rows, "k string, i int, v double"), "v", "i", ["k"]).toPandas()
    flagged = got[got["out_of_control"]]["position"].tolist()
    assert 90 in flagged and len(flagged) < 8 and not got[got["k"] == "b"]["out_of_control"].any()


def test_t_intervals_cover(spark):
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(5).normal(7, 2, 200)], "v double")
    for style in ("robust", "classical"):
        r = univariate.confidence_interval(df, "v", style=style).first()
        assert r["ci_low"] < 7 < r["ci_high"]
    assert D.t_ppf(0.975, 199) < 2


def test_more_of_pca(data, spark):
    names, m, df = data
    df = scaling.Scaler.fit(df, names[:5]).transform(df)
    fit = latent.PCA.fit(df, names[:5], 4)
    assert latent.parallel_analysis(fit, 30) == 2
    assert abs(latent.project_variables(fit, df, ["y"])["y"][0]) <= 1
    shares = latent.observation_contributions(fit, df).toPandas()[["share_t1", "share_t2"]].sum()
    assert np.allclose(shares, 1)
    assert latent.select_rule([3, 2, 1.05, 1.0], [0.1] * 4) == 3 and latent.select_rule([3, 2, 1.05, 1.0], rule="min") == 4 and latent.select_rule([3, 2, 1.999, 1.99], rule="increment") == 2
    assert 0 <= latent.rv2_coefficient(m, [0, 1], [2, 3]) <= 1


def test_published_experiments(spark):
    from millrace.operators import doe
    from millrace.sources.datasets import TABLES, data as published

    found = {r["term"]: r["effect"] for r in doe.effects(published(spark, "pollutant"), "y", ["C", "T", "S"]).collect()}
    assert found == pytest.approx({"C": 12.5, "T": 1.5, "S": -14.5, "C:T": 0.5, "C:S": -13.5, "T:S": -0.5})
    assert [published(spark, n).count() for n in sorted(TABLES)] == [11, 16, 8, 16]
    with pytest.raises(ValueError, match="golf"):
        published(spark, "nothing")


def test_parallel_analysis_uses_all_rows():
    k = 5
    model = latent.PCA([f"c{i}" for i in range(k)], np.eye(k), np.sqrt(np.array([1.03, 1.0, 0.99, 0.99, 0.99])), 1_000_000, np.ones(k), np.ones(k))
    assert latent.parallel_analysis(model) == 1  # noise of a million rows stays within 1%, of 2,000 it does not
    model.n = 2000
    assert latent.parallel_analysis(model) == 0
    model.n = 4
    assert latent.parallel_analysis(model) == 0


def test_fits_keep_their_digits_far_from_zero(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 3))
    y = 2 + 3 * x[:, 0] - x[:, 1] + 0.1 * r.normal(size=2000)
    for shift in (0.0, 1e6, 1e8):
        m = np.column_stack([x + shift, y + shift])
        df = spark.createDataFrame(m.tolist(), "a double, b double, c double, y double").repartition(3)
        fit = linear.OLS.fit(df, "y", ["a", "b", "c"])
        expected = np.linalg.lstsq(np.column_stack([np.ones(2000), x]), y, rcond=None)[0]
        assert np.allclose(fit.beta[1:], expected[1:], atol=1e-6)
        assert np.isclose(fit.rss, ((y - np.column_stack([np.ones(2000), x]) @ expected) ** 2).sum(), rtol=1e-5)
        centred = x - x.mean(0)
        hat = np.einsum("ij,jk,ik->i", centred, np.linalg.inv(centred.T @ centred), centred) + 1 / 2000
        assert np.isclose(fit.residuals(df).agg({"leverage": "max"}).first()[0], hat.max(), rtol=1e-5)
        pls = latent.PLS.fit(df, ["a", "b", "c"], ["y"], 3)
        assert np.allclose(pls.beta[:, 0], expected[1:], atol=1e-6)
        assert abs(linear.lm(df, "y ~ a + b").beta[1] - 3) < 0.02
        assert abs(latent.rv_coefficient(df, ["a"], ["y"]) - np.corrcoef(x[:, 0], y)[0, 1] ** 2) < 1e-6


def test_median_slopes_of_many_points_are_those_of_all_pairs(monkeypatch):
    r = np.random.default_rng(6)
    x, y = r.integers(0, 40, 900).astype(float), np.round(900 + r.normal(size=900), 1)
    for a, b in ((x, y), (np.repeat(x[:90], 10), np.repeat(y[:90], 10)), (1.7e9 + 1e6 * r.random(701), r.normal(size=701)), (np.arange(500.0), np.arange(500.0) * 2)):
        monkeypatch.setattr(robust, "ALL_PAIRS", 5000)
        whole, own = robust.repeated_median_slope_of(a, b), robust._inner_medians
        monkeypatch.setattr(robust, "ALL_PAIRS", 200)
        monkeypatch.setattr(robust, "SAMPLE", 64)
        asked = []
        monkeypatch.setattr(robust, "_inner_medians", lambda x, y, at, own=own, asked=asked: asked.append(len(at)) or own(x, y, at))
        assert robust.repeated_median_slope_of(a, b) == whole
        assert len(set(b)) < 100 or sum(asked) < 0.7 * len(a) or (np.diff(b) == 2).all()
        monkeypatch.setattr(robust, "_inner_medians", own)


def test_lines_of_an_elbow_at_once_and_far_from_zero():
    r = np.random.default_rng(7)
    x = np.sort(r.random(40))
    y = 2 * x + r.normal(size=40) / 20
    y[::7] += 3
    first, count = np.array([0, 0, 20, 5]), np.array([5, 20, 20, 30])
    b, m = robust.huber_lines(x, y, first, count)
    for i, (f, n) in enumerate(zip(first, count, strict=True)):
        assert np.allclose((b[i], m[i]), robust.huber_line(x[f : f + n], y[f : f + n]), atol=1e-7)
    bend = np.where(x < 0.5, x, 0.5 + 0.1 * (x - 0.5)) + r.normal(size=40) / 1e3
    near = robust.elbow_of(x, bend)
    far = 2.0**31 + 2.0**-20 * np.round(x * 2**10)
    assert robust.elbow_of(far, bend) == far[np.flatnonzero(x == near)[0]]


def test_missing_cells_by_patterns_agree_with_passes(spark, monkeypatch):
    r = np.random.default_rng(9)
    x = r.normal(size=(90, 2)) @ r.normal(size=(2, 4)) + 0.3 * r.normal(size=(90, 4))
    x[r.random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in row) for row in x], "a double, b double, c double, d double").repartition(3)
    asked, own = [], latent.pattern_products
    monkeypatch.setattr(latent, "pattern_products", lambda *a: asked.append(1) or own(*a))
    got = latent.fit_missing(df, list("abcd"), 2, most=8)
    assert len(asked) == 1
    monkeypatch.setattr(latent, "PATTERN_COLUMNS", 0)
    plain = latent.fit_missing(df, list("abcd"), 2, most=8)
    assert np.allclose(got.loadings, plain.loadings, atol=1e-9) and np.allclose(got.score_scale, plain.score_scale) and np.allclose(got.r2_cumulative, plain.r2_cumulative)


def test_two_scaled_variables_of_weak_and_negative_correlation(spark):
    assert latent.positive(np.array([[-(0.5**0.5)], [0.5**0.5 + 1e-15]])).tolist() == [-1.0]
    r = np.random.default_rng(10)
    x = r.normal(size=400)
    y = r.normal(size=400)
    y = y - y.mean() - (x - x.mean()) * (np.corrcoef(x, y)[0, 1] * y.std() / x.std() + 1e-7)
    x, y = 1e5 * (x - x.mean()) / x.std(ddof=1), y / y.std(ddof=1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x / 1e5 * (1 + 3e-13), y, strict=True)], "a double, b double")
    p = latent.PCA.fit(df, ["a", "b"], 1).loadings[:, 0]
    assert p[0] > 0 > p[1] and np.allclose(np.abs(p), 0.5**0.5, atol=1e-12)
