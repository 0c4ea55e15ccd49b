"""T-shaped models against the plain iteration over whole matrices."""

import numpy as np
import pytest

from millrace.operators.tpls import TPLS


def slope(x, known, b):
    """Each row's regression on b over known cells."""
    d = known @ b**2
    return np.divide(x @ b, d, out=np.zeros(len(x)), where=d != 0)


def auto(x):
    known = ~np.isnan(x)
    sd = np.nanstd(x, axis=0, ddof=1)
    return np.where(known, (x - np.nanmean(x, axis=0)) / sd, 0), known.astype(float)


def plain(d, f, z, y, components):
    """Vectors over lots, iterated step by step as published."""
    d = [auto(x) for x in d]
    d = [(x / np.sqrt(x.size), k) for x, k in d]
    f, z, y = [auto(x) for x in f], auto(z) if z is not None else None, auto(y)
    scores, hats = [], 0
    for _ in range(components):
        u, before = y[0][:, 0], None
        while before is None or np.linalg.norm(u - before) > 1e-12 * np.linalg.norm(before):
            before = u
            h = [slope(x.T, k.T, u) for x, k in f]
            s = [slope(x.T, k.T, v) for (x, k), v in zip(d, h)]
            s = [v / np.linalg.norm(np.concatenate(s)) for v in s]
            r = [slope(x, k, v) for (x, k), v in zip(d, s)]
            t = [slope(np.hstack([x for x, _ in f]), np.hstack([k for _, k in f]), np.concatenate(r))]
            if z is not None:
                w = slope(z[0].T, z[1].T, u)
                t = [slope(z[0], z[1], w / np.linalg.norm(w)), *t]
            t = np.stack(t, 1)
            v, old = y[0][:, 0], None
            while old is None or np.linalg.norm(v - old) > 1e-13 * np.linalg.norm(old):
                old = v
                a = t.T @ v
                a = a / np.linalg.norm(a)
                ts = t @ a
                q = slope(y[0].T, y[1].T, ts)
                v = slope(y[0], y[1], q)
            u = v
        if q[np.abs(q).argmax()] < 0:
            ts, q = -ts, -q
        take = lambda m: (m[0] - np.outer(ts, slope(m[0].T, m[1].T, ts)) * m[1], m[1])
        f = [take(m) for m in f]
        z = take(z) if z is not None else None
        d = [(x - np.outer(v, slope(x.T, k.T, v)) * k, k) for (x, k), v in zip(d, r)]
        y = (y[0] - np.outer(ts, q) * y[1], y[1])
        scores.append(ts)
        hats = hats + np.outer(ts, q)
    return np.stack(scores, 1), hats, y[0]


def made(seed, holes, conditions=True):
    r = np.random.default_rng(seed)
    d = [r.normal(size=(7, 4)), r.normal(size=(5, 3))]
    f = [r.dirichlet(np.ones(7), 60), r.dirichlet(np.ones(5), 60)]
    z = r.normal(size=(60, 3)) if conditions else None
    y = np.hstack([f[0] @ d[0][:, :1] + f[1] @ d[1][:, :1], f[0] @ d[0][:, 1:2]]) + (0.3 * z[:, :2] if conditions else 0) + 0.05 * r.normal(size=(60, 2))
    if holes:
        for x in (*d, *f, *([z] if conditions else []), y):
            x[r.random(x.shape) < 0.06] = np.nan
    return d, f, z, y


def tables(spark, d, f, z, y):
    long = [(f"g{g}", f"m{i}", f"p{j}", float(v)) for g, x in enumerate(d) for (i, j), v in np.ndenumerate(x) if not np.isnan(v)]
    cells = [(int(i), f"g{g}", f"m{j}", float(v)) for g, x in enumerate(f) for (i, j), v in np.ndenumerate(x) if not np.isnan(v)]
    wide = lambda x, n: spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in row)) for i, row in enumerate(x)], "lot long, " + ", ".join(f"{n}{k} double" for k in range(x.shape[1])))
    return (
        spark.createDataFrame(long, "group string, material string, property string, value double"),
        spark.createDataFrame(cells, "lot long, group string, material string, value double"),
        wide(z, "z") if z is not None else None,
        wide(y, "y"),
    )


@pytest.mark.parametrize(("holes", "conditions"), [(False, True), (True, True), (True, False)])
def test_against_the_plain_iteration(spark, holes, conditions):
    data = made(3, holes, conditions)
    d, f, z, y = tables(spark, *data)
    model = TPLS.fit(d, f, z, y, 2, tolerance=1e-11)
    scores, hats, left = plain(*data, 2)
    got = {r["lot"]: r for r in model.diagnose(f, z).collect()}
    t = np.array([[got[i]["t1"], got[i]["t2"]] for i in range(60)])
    assert np.allclose(t, scores, atol=1e-6)
    center, scale = model.scales["Y"]
    assert np.allclose([[got[i][f"y{k}_hat"] for k in range(2)] for i in range(60)], hats * scale + center, atol=1e-6)
    first = auto(data[3])[0]
    assert np.allclose(model.r2["Y"].sum(0), 1 - (left**2).sum(0) / (first**2).sum(0), atol=1e-6)
    assert np.allclose(model.score_scale**2, (scores**2).mean(0), atol=1e-6)


def test_absent_amounts_as_zeros_and_importance(spark):
    d, f, z, y = made(5, False)
    f = [np.where(x < 0.1, 0.0, x) for x in f]
    full = TPLS.fit(*tables(spark, d, f, z, y), 2)
    td, tf, tz, ty = tables(spark, d, f, z, y)
    sparse = TPLS.fit(td, tf.filter("value > 0"), tz, ty, 2, absent="zero")
    for a, b in zip(full.found, sparse.found):
        assert np.allclose(a.q, b.q, atol=1e-6) and np.allclose(a.p, b.p, atol=1e-6)
    assert sparse.score(tf.filter("value > 0"), tz, ty) == pytest.approx(full.score(tf, tz, ty), abs=1e-6)
    for block, n in (("D", 7), ("F", 12)):
        vip = full.vip(block)
        s = np.stack([c.s if block == "D" else c.p for c in full.found], 1)
        groups = np.array([g for g, _ in vip])
        r2 = np.mean([full.r2[block][:, groups == g].mean(1) for g in ("g0", "g1")], axis=0)
        assert len(vip) == n and np.allclose(list(vip.values()), np.sqrt(n * (s**2 @ r2) / r2.sum()))
    assert full.vip("D")["g0", "p0"] > full.vip("D")["g0", "p3"]
    assert set(full.vip("D", "deflated")) == set(full.vip("D"))
    assert full.t2_limit() > 0


def test_odd_tables(spark):
    d, f, z, y = tables(spark, *made(7, False))
    # a column without variance, cells given twice, a lot without qualities
    from pyspark.sql import functions as F

    half = f.withColumn("value", F.col("value") / 2)
    model = TPLS.fit(d, half.union(half), z.withColumn("z9", F.lit(1.0)), y.filter("lot < 50"), 1)
    assert model.n == 50 and model.diagnose(f, z.withColumn("z9", F.lit(1.0))).count() == 60
    with pytest.raises(Exception, match="material without properties"):
        TPLS.fit(d.filter("material <> 'm1'"), f, z, y, 1)
