"""Validation of component counts against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import validation as V
from millrace.operators.latent import PLS


def table(spark, x, names):
    return spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names))


def keys_of(df):
    return np.array([r["h"] for r in df.select("id", V.row_key([], "id").alias("h")).orderBy("id").collect()])


def test_cells_against_repeated_reconstruction(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(80, 2)) @ r.normal(size=(2, 5)) + 0.3 * r.normal(size=(80, 5)) + 7
    df = table(spark, x, "abcde")
    got = V.press_by_cells(df, list("abcde"), 3, folds=4, key="id", most=12)
    columns = V.spread(np.arange(1, 6, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    fold = V.spread(keys_of(df).view(np.uint64)[:, None] ^ columns) % np.uint64(4)
    for a in range(1, 4):
        for f in range(4):
            held = fold == f
            known = np.where(held, np.nan, x)
            center, scale = np.nanmean(known, 0), np.nanstd(known, 0, ddof=1)
            z = np.where(held, 0.0, (x - center) / scale)
            for _ in range(12):
                _, _, vt = np.linalg.svd(z, full_matrices=False)
                new = np.where(held, z @ vt[:a].T @ vt[:a], z)
                moved, was = np.linalg.norm(((new - z) * scale)[held]), np.linalg.norm((z * scale + center)[held])
                z = new
                if moved < 1e-6 * max(1, was):
                    break
            assert got.per_fold[a - 1, f] == pytest.approx((((x - center) / scale - z) * scale)[held].__pow__(2).sum(), rel=1e-6)
    assert got.press == pytest.approx(got.per_fold.sum(1)) and got.recommended() == 2
    assert all(abs((fold == f).mean() - 0.25) < 0.08 for f in range(4))


def test_cells_with_gaps_and_constant_columns(spark):
    r = np.random.default_rng(2)
    x = np.column_stack([r.normal(size=(60, 3)), np.full(60, 4.0)])
    x[r.random(x.shape) < 0.1] = np.nan
    got = V.press_by_cells(table(spark, x, "abcd"), list("abcd"), 9, key="id")
    assert got.press.shape == (4,) and np.isfinite(got.press).all()


def test_signs_are_fair_and_repeatable():
    s = V.signs(np.arange(4000) - 2000, 999, 3)
    assert s.shape == (4000, 999) and set(np.unique(s)) == {-1.0, 1.0}
    assert np.abs(s.mean(0)).max() < 0.08 and np.abs(np.corrcoef(s[:, :40].T) - np.eye(40)).max() < 0.08
    assert (s == V.signs(np.arange(4000) - 2000, 999, 3)).all() and (s != V.signs(np.arange(4000) - 2000, 999, 4)).any()


def test_fewer_components_by_randomised_signs(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(150, 5))
    y = x[:, :1] * 2 - x[:, 1:2] + 0.2 * x[:, 2:3] ** 2 + 0.5 * r.normal(size=(150, 1))
    df = table(spark, np.hstack([x, y]), ["a", "b", "c", "d", "e", "y"])
    got = V.compare_components(df, list("abcde"), ["y"], 4, key="id", fold=F.col("id") % 5)
    error = np.zeros((4, 150))
    for f in range(5):
        held = np.arange(150) % 5 == f
        z = np.hstack([x, y])[~held]
        for a in range(1, 5):
            m = PLS.of_products(len(z), z.sum(0), z.T @ z, list("abcde"), ["y"], a)
            fit = (x[held] - m.center[:5]) @ m.beta + m.center[5:]
            error[a - 1, held] = ((y[held] - fit)[:, 0] / y.std(ddof=1)) ** 2
    assert got.rmsecv == pytest.approx(np.sqrt(error.sum(1) / 150), rel=1e-6)
    best = int(error.sum(1).argmin())
    s = V.signs(keys_of(df), 999, 0)
    for a in range(4):
        d = error[a] - error[best]
        assert got.excess[a] == pytest.approx(d.sum(), abs=1e-6)
        assert got.p_values[a] == pytest.approx(1.0 if a == best else ((d @ s >= d.sum() - 1e-9).sum() + 1) / 1000, abs=2e-3)
    assert got.recommended == next(a + 1 for a in range(4) if got.p_values[a] > 0.01)
    assert got.p_values[0] < 0.05 or got.recommended == 1


def test_risk_of_components(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 3))
    df = table(spark, np.column_stack([x, x[:, 0] + 0.5 * r.normal(size=300)]), ["a", "b", "c", "y"])
    got = V.component_risk(df, list("abc"), "y", 3, key="id")
    assert got[0]["risk"] == 0.001 and got[0]["statistic"] > 0.8 and got[-1]["risk"] > 0.02


def test_fractions_of_rows(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 2)) + 100
    df = table(spark, np.column_stack([x, x @ [1.0, 2.0] + r.normal(size=400)]), ["a", "b", "y"])

    def slope(n, s, p):
        c = p - np.outer(s, s) / n
        return np.linalg.solve(c[:2, :2], c[:2, 2])

    whole, mean, low, high = V.fractional(df, ["a", "b", "y"], slope, fraction=0.5, repeats=60, key="id")
    data = np.column_stack([x, [row["y"] for row in df.orderBy("id").collect()]])
    assert whole == pytest.approx(slope(400, data.sum(0), data.T @ data), rel=1e-6)
    draws = np.arange(1, 61, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    chosen = (V.spread(V.spread(keys_of(df).view(np.uint64))[:, None] + V.spread(draws)) >> np.uint64(11)).astype(float) < 0.5 * 2.0**53
    fits = np.array([slope(c.sum(), data[c].sum(0), data[c].T @ data[c]) for c in chosen.T])
    assert mean == pytest.approx(fits.mean(0), rel=1e-6) and low == pytest.approx(np.quantile(fits, 0.025, axis=0), rel=1e-6)
    assert (low < whole).all() and (whole < high).all() and abs(chosen.mean() - 0.5) < 0.02
    with pytest.raises(ValueError):
        V.fractional(df, ["a", "b", "y"], slope, fraction=0)


def test_cells_by_patterns_agree_with_passes_and_need_two(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = r.normal(size=(70, 2)) @ r.normal(size=(2, 4)) + 0.4 * r.normal(size=(70, 4)) + 50
    x[r.random(x.shape) < 0.1] = np.nan
    df = table(spark, x, "abcd")
    got = V.press_by_cells(df, list("abcd"), 3, folds=3, key="id", most=9)
    monkeypatch.setattr(V, "PATTERN_COLUMNS", 0)
    plain = V.press_by_cells(df, list("abcd"), 3, folds=3, key="id", most=9)
    assert got.passes == 2 < plain.passes and got.per_fold == pytest.approx(plain.per_fold, rel=1e-9)
