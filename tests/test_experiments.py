import numpy as np
import pytest

from millrace.functions import charts
from millrace.operators import experiments, latent, resampling


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 3))
    y = 5 + 2 * x[:, 0] - x[:, 1] + 1.5 * x[:, 0] * x[:, 1] + 0.1 * r.normal(size=200)
    m = np.column_stack([np.arange(200), x, y])
    return m, spark.createDataFrame([(int(v[0]), *map(float, v[1:])) for v in m], "id long, A double, B double, C double, y double").repartition(4)


def test_anova_and_selection(data):
    m, df = data
    table = {r["term"]: r for r in experiments.anova(df, "y ~ A*B + C")}
    a = np.column_stack([np.ones(200), m[:, 1:4]])
    rss = lambda c: np.linalg.lstsq(a[:, c], m[:, 4], rcond=None)[1][0]
    assert np.isclose(table["A"]["sum_sq"], rss([0, 2, 3]) - rss([0, 1, 2, 3]))
    assert table["A:B"]["p_value"] < 1e-10 and table["C"]["p_value"] > 1e-4 and table["Residual"]["df"] == 195
    assert set(experiments.select_model(df, "y ~ A*B + C", "bic")) >= {"A", "B", "A:B"}
    assert set(experiments.select_model(df, "y ~ A*B + C", "bic", forward=True)) >= {"A", "B", "A:B"}


def test_box_cox_and_curvature(spark):
    r = np.random.default_rng(0)
    logs = spark.createDataFrame([(float(v),) for v in np.exp(r.normal(size=2000))], "y double")
    assert abs(experiments.box_cox(logs, "y")["lambda"]) <= 0.1
    rows = [(float(a), float(b), 10.0 + r.normal() * 0.1) for a in (-1, 1) for b in (-1, 1)] + [(0.0, 0.0, 15.0 + 0.1 * k) for k in range(4)]
    got = experiments.curvature(spark.createDataFrame(rows, "A double, B double, y double"), "y", ["A", "B"])
    assert got["difference"] < -4 and got["p_value"] < 0.001


def test_resampled_coefficients(data):
    m, df = data
    groups = resampling.grouped_products(df, ["A", "B", "y"], 20, "id")
    assert sum(g[0] for g in groups) == 200
    fit = lambda n, sums, products: latent.PLS.of_products(n, sums, products, ["A", "B"], ["y"], 2).beta[:, 0]
    whole, se = resampling.jackknife(groups, fit)
    again, low, high = resampling.bootstrap(groups, fit, 50)
    assert np.allclose(whole, again) and (low < whole).all() and (whole < high).all() and (se > 0).all()


def test_charts(data):
    _, df = data
    spec = charts.with_limits(charts.scatter(df, "A", "y", most=50), ucl=9.0)
    assert spec["sampled"] and len(spec["layers"][0]["data"]) == 50
    assert len(charts.to_plotly(spec)["data"]) == 2 and len(charts.to_echarts(spec)["series"]) == 2
    assert charts.pareto(["a", "b"], [1, -3])["layers"][0]["data"][0]["name"] == "b"
