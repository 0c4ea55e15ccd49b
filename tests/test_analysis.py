import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import analyze, chartdata, experiments, latent, linear, optimize, sensory, structures, univariate, validation
from millrace.sources.datasets import data


@pytest.fixture(scope="module")
def runs(spark):
    r = np.random.default_rng(2)
    x = np.array([[a, b] for a in (-1, 0, 1) for b in (-1, 0, 1)] * 4, float)
    y = 20 + 3 * x[:, 0] - 2 * x[:, 1] + x[:, 0] * x[:, 1] + 0.3 * r.normal(size=len(x))
    rows = [(i + 1, *map(float, v), float(w)) for i, (v, w) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "RunOrder int, A double, B double, y double").repartition(3), x, y


def test_formulas_by_name():
    assert analyze.build_formula("y", ["a", "b"]) == "y ~ (a + b) ** 2"
    assert analyze.build_formula("y", ["a", "b"], "main_effects") == "y ~ a + b"
    assert "I(b ** 2)" in analyze.build_formula("y", ["a", "b"], "quadratic")
    assert analyze.build_formula("y", ["a"], "y ~ a") == "y ~ a" and analyze.build_formula("y", ["a"], "a + c") == "y ~ a + c"


def test_one_entry_agrees_with_plain_least_squares(runs):
    df, x, y = runs
    every = ("anova", "effects", "coefficients", "significance", "confidence_intervals", "residual_diagnostics", "lack_of_fit", "curvature", "model_selection", "box_cox", "lenth", "prediction", "confirmation", "summary")
    out = analyze.analyze_experiment(df, "y", ["A", "B"], analyses=every, points=df, observed="y")
    m = np.column_stack([np.ones(len(x)), x, x[:, 0] * x[:, 1]])
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    hat = m @ beta
    assert np.allclose([c["coefficient"] for c in out.results["coefficients"]], beta)
    h = np.einsum("ij,jk,ik->i", m, np.linalg.inv(m.T @ m), m)
    s = out.results["summary"]
    assert math.isclose(s["predicted_r2"], 1 - (((y - hat) / (1 - h)) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel_tol=1e-9)
    mse = ((y - hat) ** 2).sum() / (len(y) - 4)
    assert math.isclose(s["adequate_precision"], (hat.max() - hat.min()) / math.sqrt(4 * mse / len(y)), rel_tol=1e-9)
    assert set(out.results["significance"]["significant"]) == {"A", "B", "A:B"}
    e = y - hat
    assert math.isclose(out.results["residual_diagnostics"]["durbin_watson"], (np.diff(e) ** 2).sum() / (e**2).sum(), rel_tol=1e-9)
    rows = out.results["prediction"].orderBy("RunOrder").collect()
    assert np.allclose([r.predicted for r in rows], hat) and all(r.pi_low < r.ci_low < r.predicted < r.ci_high < r.pi_high for r in rows)
    assert sum(r.within_pi for r in out.results["confirmation"].collect()) >= 0.85 * len(y)
    with pytest.raises(ValueError):
        analyze.analyze_experiment(df, "y", ["A"], analyses=("nothing",))
    logged = analyze.analyze_experiment(df, "y", ["A", "B"], "main_effects", ("effects",), transform="log")
    assert math.isclose(logged.model.beta[0], np.log(y).mean(), rel_tol=1e-9)


def test_surfaces_and_their_best_settings(spark, runs):
    df, _, _ = runs
    fit = linear.lm(df, "y ~ A * B + I(A ** 2)")
    surface = optimize.surface_of(fit)
    assert set(surface) == {(), ("A",), ("B",), ("A", "B"), ("A", "A")}
    s = {(): 10.0, ("A",): 2.0, ("B",): -1.0, ("A", "A"): -3.0, ("B", "B"): -2.0, ("A", "B"): 0.5}
    b, q = optimize.quadratic_form(s, ["A", "B"])
    best = np.linalg.solve(q, -b / 2)
    found = optimize.optimize_responses(spark, {"y": s}, {"A": (-1.0, 1.0), "B": (-1.0, 1.0)}, goals={"y": {"goal": "maximize", "low": 0.0, "high": 20.0}})
    assert abs(found["A"] - best[0]) < 1e-3 and abs(found["B"] - best[1]) < 1e-3
    canonical = optimize.optimize_responses(spark, {"y": s}, {"A": (-1.0, 1.0), "B": (-1.0, 1.0)}, "canonical_analysis")
    assert canonical["kind"] == "maximum" and canonical["inside"] and np.isclose(canonical["x"]["A"], best[0])
    for row in optimize.ridge_analysis(s, ["A", "B"], [0.1, 1.0, 2.0]):
        angle = np.linspace(0, 2 * np.pi, 20_001)
        p = row["radius"] * np.column_stack([np.cos(angle), np.sin(angle)])
        assert np.isclose(math.hypot(row["A"], row["B"]), row["radius"], atol=1e-6)
        assert row["response"] >= (10 + p @ b + np.einsum("ij,jk,ik->i", p, q, p)).max() - 1e-6
    with pytest.raises(ValueError):
        optimize.optimize_desirability(spark, {"y": s}, {"z": {}}, {"A": (-1, 1)})


def test_pareto_front_of_any_number_of_responses(spark):
    r = np.random.default_rng(4)
    y = np.round(r.random((300, 3)), 2)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(y)], "id long, a double, b double, c double").repartition(4)
    z = y * [1, -1, 1]
    plain = {i for i in range(300) if not ((z >= z[i]).all(axis=1) & (z > z[i]).any(axis=1)).any()}
    assert {x.id for x in optimize.pareto_front(df, {"a": "maximize", "b": "minimize", "c": "maximize"}).collect()} == plain


def test_factors_sets_and_words(spark):
    df = spark.createDataFrame([(1, 10.0, "a"), (2, 20.0, "b"), (3, 30.0, None)], "k long, t double, g string")
    f = structures.Factor.from_data(df, "t")
    assert (f.low, f.high, f.center, f.range) == (10.0, 30.0, 20.0, 20.0) and structures.Factor.from_data(df, "g").levels == ("a", "b")
    coded = structures.Experiment(df, [f]).to_coded()
    assert [r.t for r in coded.orderBy("k").collect()] == [-1, 0, 1]
    assert [r.t for r in structures.Experiment(coded, [f]).to_realworld().orderBy("k").collect()] == [10, 20, 30]
    with pytest.raises(ValueError):
        structures.Factor("x", 2.0, 1.0)
    with pytest.raises(ValueError):
        structures.gather({"a": df.select("k", "t"), "b": df.filter("k > 1").select("k", "t")}, "k")
    assert structures.supplement(df, "t", units="K").schema["t"].metadata == {"units": "K"}
    wide = spark.createDataFrame([(1, 5.0, None, 7.0)], "b long, x_1 double, x_2 double, y_z_1 double")
    assert sorted((r.tag, r.position, r.value) for r in structures.unwiden(wide, "b", ["x_1", "x_2", "y_z_1"]).collect()) == [("x", 1, 5.0), ("y_z", 1, 7.0)]
    other = spark.createDataFrame([(2,), (2,), (9,)], "k long")
    assert sorted((r.k, r.found_in) for r in structures.key_sets(df.select("k"), other, ["k"]).collect()) == [(1, "left"), (2, "both"), (3, "left"), (9, "right")]
    top = structures.keyword_rank(spark.createDataFrame([(1, "Red fox, red"), (2, "blue fox"), (3, "")], "k long, w string"), "k", "w", "a red FOX!", 1).collect()
    assert [(r.k, r.score) for r in top] == [(1, 2)]


def test_fits_and_ranks_over_sorted_ranges(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(3, 2, 500), np.repeat(1.5, 40)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    assert sorted(row["rank"] for row in univariate.ranked(df, []).collect()) == list(range(1, len(x) + 1))
    got = univariate.distribution_fit(df, "x").first()
    s = np.sort(x)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in (s - s.mean()) / s.std()])
    n = len(s)
    assert math.isclose(got.distance, max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max()), rel_tol=1e-9)
    approximate = univariate.median_absolute_deviation(df, "x", exact=False).first().mad
    assert abs(approximate - univariate.median_absolute_deviation(df, "x").first().mad) < 0.05


def test_blocks_agree_with_the_hierarchical_iteration(spark):
    r = np.random.default_rng(5)
    t = r.normal(size=(200, 2))
    x = np.column_stack([t @ r.normal(size=(2, 3)), t @ r.normal(size=(2, 2))]) + 0.3 * r.normal(size=(200, 5))
    y = t[:, 0] + 0.1 * r.normal(size=200)
    df = spark.createDataFrame([(i, *map(float, v), float(w)) for i, (v, w) in enumerate(zip(x, y, strict=True))], "id long, a1 double, a2 double, a3 double, b1 double, b2 double, y double").repartition(3)
    blocks = {"a": ["a1", "a2", "a3"], "b": ["b1", "b2"]}
    z = [(x[:, s] - x[:, s].mean(0)) / x[:, s].std(0, ddof=1) for s in (slice(0, 3), slice(3, 5))]
    model = latent.MultiBlock.fit(df, blocks, 2)
    got = model.diagnose(df).orderBy("id").toPandas()
    for a in (1, 2):
        score = z[0][:, 0] + 0.1 * z[1][:, 0]
        for _ in range(2000):
            p = [b.T @ score for b in z]
            p = [v / np.linalg.norm(v) for v in p]
            own = np.column_stack([b @ v / math.sqrt(b.shape[1]) for b, v in zip(z, p, strict=True)])
            w = own.T @ score
            w /= np.linalg.norm(w)
            score = own @ w
        sign = np.sign(score @ got[f"super_t{a}"])
        assert np.allclose(got[f"super_t{a}"], sign * score, atol=1e-6)
        assert np.allclose(got[f"a_t{a}"], sign * own[:, 0], atol=1e-6) and np.allclose(model.super_weights()[:, a - 1], np.abs(w), atol=1e-6)
        z = [b - np.outer(score, v * k * math.sqrt(b.shape[1])) for b, v, k in zip(z, p, w, strict=True)]
    assert np.allclose(got["a_spe"], np.sqrt((z[0] ** 2).sum(1)), atol=1e-6)
    assert np.allclose(got["super_spe"] ** 2, got["a_spe"] ** 2 + got["b_spe"] ** 2)
    terms = model.score_contributions(df, 2).orderBy("id").toPandas()[[f"{c}_t2" for c in model.columns]]
    assert np.allclose(terms.sum(axis=1), got["super_t2"])
    assert 0.02 < (got["super_spe"] > model.super_spe_limit()).mean() + (got["hotellings_t2"] > model.t2_limit()).mean() < 0.2
    pls = latent.MultiBlock.fit(df, blocks, 2, ["y"])
    hat = pls.diagnose(df).orderBy("id").toPandas()["y_hat"]
    assert np.corrcoef(hat, y)[0, 1] > 0.95


def test_orthogonal_models_are_inverted_and_components_chosen(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 4)) * [3, 2, 0.2, 0.2]
    y = x[:, 0] - x[:, 1] + 0.1 * r.normal(size=300)
    df = spark.createDataFrame([(*map(float, v), float(w)) for v, w in zip(x, y, strict=True)], "a double, b double, c double, d double, y double")
    model = latent.OPLS.fit(df, ["a", "b", "c", "d"], "y", 1)
    point, directions = model.invert(2.0)
    at = spark.createDataFrame([tuple(map(float, point)), tuple(map(float, point + 0.7 * directions[:, 0]))], "a double, b double, c double, d double")
    assert np.allclose([row.y_hat for row in model.transform(at).collect()], 2.0, atol=0.2)
    assert model.correct(df).columns[-4:] == ["a_corrected", "b_corrected", "c_corrected", "d_corrected"]
    assert latent.minka_components(latent.PCA.fit(df, ["a", "b", "c", "d"], 4)) == 2
    risk = validation.component_risk(df, ["a", "b", "c", "d"], "y", 1, draws=99)
    assert risk[0]["risk"] == 0.01 and risk[0]["statistic"] > 0.8


def test_chart_data(spark, runs):
    df, x, y = runs
    means = {(r.factor, float(r.level)): r.mean for r in chartdata.create("main_effects", df, "y", ["A", "B"]).collect()}
    assert np.isclose(means["A", 1.0], y[x[:, 0] == 1].mean()) and len(means) == 6
    assert chartdata.create("corners", df, "y", ["A", "B"]).count() == 4
    half = chartdata.create("half_normal", spark.createDataFrame([("a", -3.0), ("b", 1.0)], "term string, effect double")).collect()
    assert [r.term for r in half] == ["b", "a"] and half[0].quantile < half[1].quantile
    with pytest.raises(ValueError):
        chartdata.create("nothing")
    steps = chartdata.create("fraction_of_design_space", spark, linear.lm(df, "y ~ A + B"), {"A": (-1.0, 1.0), "B": (-1.0, 1.0)}, 5).orderBy("fraction").collect()
    assert steps[-1].fraction == 1.0 and all(a.variance <= b.variance for a, b in zip(steps, steps[1:], strict=False))
    assert chartdata.create("raincloud", df.withColumn("g", F.lit(1)), "y", ["g"], 4).agg(F.sum("share")).first()[0] == 1.0


def test_curvature_and_published_effects(spark):
    d = data(spark, "pollutant")
    found = analyze.analyze_experiment(d, "y", ["C", "T", "S"], "main_effects", ("effects", "anova", "lenth")).results
    assert np.isclose(found["effects"]["C"], 12.5) and np.isclose(found["effects"]["S"], -14.5)
    y = np.array([5, 30, 6, 33, 4, 3, 5, 4.0])
    assert experiments.Products.of(d, "y ~ C + T").total == pytest.approx(((y - y.mean()) ** 2).sum())


@pytest.fixture(scope="module")
def tasters(spark):
    r = np.random.default_rng(9)
    level = dict(zip("abcd", (2.0, 4.0, 6.0, 8.0), strict=True))
    rows = []
    for who in range(9):
        for product, x in level.items():
            for attribute in ("sweet", "salty"):
                for session in (1, 2, 3):
                    score = 10 - x if who == 8 else x
                    rows.append((f"p{who}", session, product, attribute, 1, float(score + 0.4 * r.normal() + 0.2 * who)))
    return spark.createDataFrame(rows, "panelist_id string, session int, product string, attribute string, replicate int, score double").repartition(3)


def test_panelists_are_flagged_and_products_compared(spark, tasters):
    flagged = {r.panelist_id: list(r.reasons) for r in sensory.flag_panelists(tasters).collect() if r.flagged}
    assert flagged == {"p8": ["low agreement with the panel"]}
    assert sensory.letters(["a", "b", "c"], [("a", "c")]) == {"a": "a", "b": "ab", "c": "b"} and sensory.letters(["a", "b"], []) == {"a": "a", "b": "a"}
    out = sensory.compare_products(structures.apply_correction(tasters, ["p8"]), control="a")
    assert {r.letters for r in out["letters"].filter("attribute = 'sweet'").collect()} == {"a", "b", "c", "d"}
    assert all(r.significant for r in out["dunnett"]["salty"].collect())
    covariates = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0)], "product string, sugar double")
    whole = sensory.analyze_descriptive(tasters, covariates, drop=["p8"], correction="both", low=-5, high=20)
    assert whole["validation"]["ok"] and whole["products"].count() == 4
    assert all(r.r > 0.99 for r in whole["relations"].collect())


def test_missing_cells_by_trimmed_scores(spark):
    r = np.random.default_rng(3)
    t = r.normal(size=(400, 2))
    x = t @ r.normal(size=(2, 5)) + 5 + 0.05 * r.normal(size=(400, 5))
    full = latent.PCA.fit(spark.createDataFrame((x - x.mean(0)).tolist(), [f"c{i}" for i in range(5)]), [f"c{i}" for i in range(5)], 2)
    holes = np.where(r.random(x.shape) < 0.08, np.nan, x)
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in holes]
    fit, mean = latent.fit_tsr(spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(5))).repartition(3), [f"c{i}" for i in range(5)], 2, most=40, tolerance=1e-7)
    assert np.allclose(mean, x.mean(0), atol=0.02) and np.allclose(np.abs(np.diag(fit.loadings.T @ full.loadings)), 1, atol=1e-3)


def test_nested_validation_agrees_with_refits(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(240, 3)) + 50
    y = x[:, 0] - 2 * x[:, 1] + 0.2 * r.normal(size=240)
    df = spark.createDataFrame([(i, *map(float, v), float(w)) for i, (v, w) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y double").repartition(3)
    got = latent.nested_cv(df, ["a", "b", "c"], ["y"], 3, outer=3, inner=2, key="id")
    place = {row.id: row.p for row in df.select("id", F.pmod(F.xxhash64("id"), F.lit(6)).alias("p")).collect()}
    for g in got:
        train = df.filter(F.col("id").isin([i for i, p in place.items() if p % 3 != g["fold"]]))
        test = df.filter(F.col("id").isin([i for i, p in place.items() if p % 3 == g["fold"]]))
        rows = latent.PLS.fit(train, ["a", "b", "c"], ["y"], g["components"], limits=False).predict(test).collect()
        assert g["n"] == len(rows) and np.isclose(g["rmsep"], math.sqrt(np.mean([(row.y - row.y_hat) ** 2 for row in rows])), rtol=1e-6)
