"""Whitening against a plain eigenvalue solution."""

import numpy as np
import pytest

from millrace.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string, component double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 5, "x", None) for i, v in rows], SCHEMA)


def plain(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)) + 1_000_000
    centred = x - x.mean(0)
    value, vector = np.linalg.eigh(centred.T @ centred / len(x))
    return x.astype(int), centred, value[::-1], vector[:, ::-1]


def held(result, x, centred, value, vector, k):
    rows = result.collect()
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    n, total = len(x), x.sum(0)
    for i in range(n):
        assert sorted(got[i]) == list(range(1, k + 1))
        assert got[i][1]["n"] == n
        assert got[i][1]["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], total))
    for j in range(k):
        z = np.array([got[i][j + 1]["whitened"] for i in range(n)])
        want = centred @ vector[:, j] / np.sqrt(value[j])
        assert min(np.abs(z - want).max(), np.abs(z + want).max()) < 1e-6
        assert got[0][j + 1]["explained"] == pytest.approx(value[j] / value.sum(), rel=1e-9)
        assert got[0][j + 1]["identity_error"] < 1e-8


def test_against_the_plain_solution(spark):
    draw = np.random.default_rng(1)
    vectors = (draw.standard_normal((300, 12)) @ np.diag(np.linspace(1, 3, 12))).astype(np.float32).tolist()
    df = table(spark, list(enumerate(vectors)) + [(900, None), (901, [float("nan")] * 12), (902, [None] * 12), (903, [float("inf")] * 12)])
    held(whitening.whiten(df, k=5), *plain(vectors), 5)


def test_many_passes_certify_close_components(spark):
    draw = np.random.default_rng(2)
    vectors = (draw.standard_normal((200, 24)) @ np.diag(np.linspace(1, 1.6, 24))).astype(np.float32).tolist()
    df = table(spark, list(enumerate(vectors)))
    rows = whitening.Rows(df)
    value, vector, trace, seen = whitening.components(rows, 3)
    x, centred, want, _ = plain(vectors)
    assert len(seen) > 3 and seen[-1] <= 1e-11 * value[0]
    assert np.allclose(value, want[:3], rtol=1e-10) and trace == pytest.approx(want.sum())
    with pytest.raises(ArithmeticError):
        whitening.components(rows, 3, passes=2)


def test_odd_tables(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    # copies, shorter vectors, a null id, huge entries: whose deviation is no long
    df = table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0]), (None, [5.0, -1.0]), (2**60 + 1, [1e30, 0.0])])
    rows = whitening.whiten(df, k=2).collect()
    assert {r["vec_id"] for r in rows} == {1, 2, None, 2**60 + 1} and len(rows) == 5 * len({r["component"] for r in rows})
    assert all(r["deviation"] is None for r in rows)
    alike = [r["whitened"] for r in rows if r["vec_id"] == 1 and r["component"] == 1]
    assert len(alike) == 2 and alike[0] == alike[1]


def test_exact_means_of_large_values(spark):
    df = table(spark, [(i, [float(i % 3), 0.5]) for i in range(7)])
    rows = whitening.Rows(df, shift=10**12)
    assert rows.n == 7 and rows.centre.sums == [sum(64 * (i % 3) + 10**12 for i in range(7)), 7 * (32 + 10**12)]
    assert rows.centre.centred(np.array([[10**12, 10**12 + 32]]))[0] == pytest.approx([-64 * 6 / 7, 0], abs=1e-12)
