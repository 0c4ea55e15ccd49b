import numpy as np

from millrace.operators import comparisons


def test_balanced_factorial(spark):
    r = np.random.default_rng(1)
    rows = [(f"a{i}", f"b{j}", float(2 * i - j + 0.5 * i * j + 0.1 * r.normal())) for i in range(3) for j in range(2) for _ in range(4)]
    got = {x["term"]: x for x in comparisons.factorial_anova(spark.createDataFrame(rows, "a string, b string, y double"), "y", "a", "b")}
    y = np.array([v for *_, v in rows])
    assert np.isclose(sum(x["sum_sq"] for x in got.values()), ((y - y.mean()) ** 2).sum()) and got["Residual"]["df"] == 18
    assert got["a"]["p_value"] < 1e-6


def test_control_and_covariates(spark):
    r = np.random.default_rng(2)
    rows = [(g, float(r.normal() + (3 if g == "c" else 0))) for g in "abc" for _ in range(30)]
    got = {x["g"]: x for x in comparisons.dunnett(spark.createDataFrame(rows, "g string, x double"), "x", "g", "a").collect()}
    assert got["c"]["significant"] and got["b"]["p_value"] > 0.01
    table = spark.createDataFrame([(float(i), float(2 * i + r.normal()), float(r.normal())) for i in range(40)], "s double, a double, b double")
    found = {x["attribute"]: x for x in comparisons.relate(table, ["a", "b"], ["s"]).collect()}
    assert found["a"]["p_bh"] < 1e-6 < found["b"]["p_bh"]
