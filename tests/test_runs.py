"""Evaluation of runs in a table against whole matrices."""

import itertools

import numpy as np
import pytest

from millrace.operators.doe import alias_matrix, evaluate_design, full_factorial, model_matrix
from millrace.operators.runs import Runs


def table(spark, x, names):
    return spark.createDataFrame([tuple(map(float, v)) for v in x], ", ".join(f"{n} double" for n in names))


@pytest.fixture(scope="module")
def design():
    r = np.random.default_rng(1)
    return np.vstack([r.uniform(-1, 1, (30, 3)), [[0.5, 0.5, -0.5]] * 4])


@pytest.mark.parametrize("model", ["linear", "interactions"])
def test_agrees_with_whole_matrices(spark, design, model):
    df = table(spark, design, "ABC")
    runs = Runs.of(df.union(df.limit(1).selectExpr("A", "B", "NULL")), "ABC")
    got, want = runs.evaluate(model), evaluate_design(design, model, samples=10)
    assert got["n"] == 34 and not got["singular"] and got["degrees_of_freedom"] == want["degrees_of_freedom"]
    for name in ("d_efficiency", "a_optimality", "e_optimality", "condition_number"):
        assert got[name] == pytest.approx(want[name], rel=1e-8)
    assert list(got["vif"].values()) == pytest.approx(want["vif"], rel=1e-8)
    m = model_matrix(design, model)
    h = np.einsum("ij,jk,ik->i", m, np.linalg.inv(m.T @ m), m)
    assert [v["variance"] for v in runs.prediction_variance(df, model).collect()] == pytest.approx(h.tolist())
    assert runs.g_efficiency(df, model) == pytest.approx(100 * m.shape[1] / (34 * h.max()))


def test_correlations_beside_main_effects(spark, design):
    x = np.column_stack([*(design[:, i] * design[:, j] for i, j in itertools.combinations(range(3), 2)), design**2])
    base = np.column_stack([np.ones(len(x)), design])
    r = np.corrcoef(x - base @ np.linalg.pinv(base) @ x, rowvar=False)
    got = Runs.of(table(spark, design, "ABC"), "ABC").correlations()
    names = ["A:B", "A:C", "B:C", "A^2", "B^2", "C^2"]
    assert all(got[names[i], names[j]] == pytest.approx(r[i, j], abs=1e-9) for i, j in itertools.combinations(range(6), 2))


def test_what_cannot_be_told_apart(spark):
    x = full_factorial(3)
    x = np.column_stack([x, -x[:, 0] * x[:, 1]])
    runs = Runs.of(table(spark, x, "ABCD"), "ABCD")
    assert runs.confounding() == {"A": ["-B:D"], "B": ["-A:D"], "D": ["-A:B"], "A:B": ["-D"], "A:D": ["-B"], "B:D": ["-A"]}
    assert all(v == 0 for v in runs.correlations().values() if v == v and abs(v) < 1e-9)
    alias = runs.alias_matrix()
    want = alias_matrix(x)
    assert [alias[t, "A:B"] for t in ("(Intercept)", "A", "B", "C", "D")] == pytest.approx(want[:, 0].tolist(), abs=1e-9)
    assert runs.evaluate("interactions")["singular"] and not runs.evaluate("linear")["singular"]
    with pytest.raises(ValueError):
        runs.evaluate("cubic")


def test_no_runs(spark):
    runs = Runs.of(table(spark, np.ones((1, 2)), "AB").limit(0), "AB")
    assert runs.n == 0 and runs.evaluate()["singular"] and runs.confounding() == {}
