"""Discrimination of descriptors against plain refits and permutations."""

import numpy as np
import pytest

from millrace.functions import distributions as D
from millrace.operators import discrimination as S
from millrace.operators.latent import PLS

X = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def products(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 4))
    x[:, 3] = x[:, 0] + 0.05 * r.normal(size=40)
    y = np.column_stack([2 * x[:, 0] - x[:, 1] + 0.4 * r.normal(size=40), r.normal(size=40)])
    data = np.hstack([x, y])
    rows = [(f"p{i:02d}", *map(float, v)) for i, v in enumerate(data)]
    return spark.createDataFrame([*rows, ("gone", None, 1.0, 1.0, 1.0, 1.0, 1.0)], "product string, a double, b double, c double, d double, y double, noise double"), data


def model(z, y):
    return PLS.of_products(len(z), z.sum(0), z.T @ z, X, [y], 2)


def test_gate_null_and_clusters(products):
    df, data = products
    gates, told = S.discriminate(df, ["y", "noise"], X, "product")
    z = data[:, :5]
    press, betas = 0.0, []
    for i in range(40):
        m = model(np.delete(z, i, 0), "y")
        press += (z[i, 4] - ((z[i, :4] - m.center[:4]) @ m.beta + m.center[4:])[0]) ** 2
        betas.append((m.rotation @ m.y_loadings.T)[:, 0])
    assert gates[0]["q2_cv"] == pytest.approx(1 - press / ((z[:, 4] - z[:, 4].mean()) ** 2).sum(), rel=1e-6) and gates[0]["predictable"]
    assert gates[0]["rmsep_cv"] == pytest.approx(np.sqrt(press / 40), rel=1e-6)
    full = model(z, "y")
    error = np.sqrt(39 / 40 * ((np.array(betas) - np.mean(betas, 0)) ** 2).sum(0))
    robust = np.abs((full.rotation @ full.y_loadings.T)[:, 0]) > D.t_ppf(0.975, 39) * error
    own = {r["descriptor"]: r for r in told if r["attribute"] == "y"}
    assert [own[c]["jackknife_significant"] for c in X] == robust.tolist()
    # one block: plain permutations of all rows, with the same random numbers
    order = np.argsort([f"p{i:02d}" for i in range(40)])
    sorted_ = z[order]
    orders = S.shuffled(40, 199, np.random.default_rng([0, 0]))
    c = np.cov(z[:, :4].T) / np.outer(full.scale[:4], full.scale[:4])
    ratio = full.selectivity_ratio(c)
    null = np.array([model(np.column_stack([sorted_[:, :4], sorted_[orders[:, b], 4]]), "y").selectivity_ratio(c) for b in range(199)])
    for i, name in enumerate(X):
        assert own[name]["selectivity_ratio"] == pytest.approx(ratio[i], rel=1e-6)
        assert own[name]["p_value"] == pytest.approx(((null[:, i] >= ratio[i]).sum() + 1) / 200)
        assert own[name]["q_value"] == pytest.approx(((null.max(1) >= ratio[i]).sum() + 1) / 200)
    assert [own[c]["cluster_id"] for c in X] == [0, 1, 2, 0]
    assert all(own[c]["discriminator_significant"] == (own[c]["q_value"] <= 0.05 and own[c]["jackknife_significant"]) for c in X)
    assert own["a"]["p_value"] < own["c"]["p_value"]
    assert not any(r["discriminator_significant"] for r in told if r["attribute"] == "noise")


def test_permutations_in_many_blocks_keep_columns(products, monkeypatch):
    df, data = products
    monkeypatch.setattr(S, "BLOCK", 8)
    rows = df.dropna().select(df["product"].alias("_key"), "a", "y")
    make = lambda z, random: np.column_stack([z[:, :1].T @ z[:, 1][S.shuffled(len(z), 300, random)], [[len(z)]]])
    got = S.block_sums(rows, "_key", make, (1, 301), 3)[0]
    again = S.block_sums(rows.repartition(7), "_key", make, (1, 301), 3)[0]
    assert got[-1] == 40 and np.allclose(got, again)
    expected = 40 * data[:, 0].mean() * data[:, 4].mean()
    assert abs(got[:-1].mean() - expected) < 12 and got[:-1].std() > 1


def test_components_of_a_graph():
    r = np.eye(6)
    for i, j in ((0, 5), (5, 2), (1, 4)):
        r[i, j] = r[j, i] = -0.97
    assert S.clusters(r, 0.95) == [0, 1, 0, 2, 1, 0]
    r[3, 0] = np.nan
    assert S.clusters(r, 0.99) == [0, 1, 2, 3, 4, 5] and S.clusters(np.zeros((0, 0)), 0.9) == []


def test_knock_offs(products):
    df, data = products
    got = {r["descriptor"]: r for r in S.knock_offs(df, ["y"], X, "product", times=30)}
    assert got["a"]["vip_exceeds_null"] and got["a"]["cv_beta_exceeds_null"]
    assert not got["c"]["cv_beta_exceeds_null"]
    alone = PLS.of_products(40, data[:, :5].sum(0), data[:, :5].T @ data[:, :5], X, ["y"], 2)
    # beside noise columns, importance keeps the order of the model without them
    assert got["a"]["vip"] > got["b"]["vip"] > got["c"]["vip"] and alone.vip()[0] > alone.vip()[2]
    kept = S.knock_offs(df, ["y"], X, "product", ignore=["d"], times=5)
    assert sorted(r["descriptor"] for r in kept) == ["a", "b", "c"]
    for bad in (dict(ignore=["q"]), dict(fraction=0), dict(quantile=1), dict(ignore=["a", "b", "c"])):
        with pytest.raises(ValueError):
            S.knock_offs(df, ["y"], X, "product", **bad)


def test_designed_factors(spark):
    r = np.random.default_rng(3)
    x = np.array(np.meshgrid([-1, 1], [-1, 1], [-1, 0, 1])).reshape(3, -1).T.astype(float)
    x = np.vstack([x, x])
    y = np.column_stack([4 * x[:, 0] + x[:, 0] * x[:, 1] + r.normal(size=24), r.normal(size=24)])
    df = spark.createDataFrame([tuple(map(float, v)) for v in np.hstack([x, y])], "A double, B double, C double, y1 double, y2 double")
    got = {(v.attribute, v.term): v for v in S.relate_designed(df, ["y1", "y2"], ["A", "B", "C"], "interactions").collect()}
    m = np.column_stack([np.ones(24), x, x[:, 0] * x[:, 1], x[:, 0] * x[:, 2], x[:, 1] * x[:, 2]])
    inverse = np.linalg.inv(m.T @ m)
    beta = inverse @ m.T @ y
    s2 = ((y - m @ beta) ** 2).sum(0) / 17
    p = {}
    for i, t in enumerate(("A", "B", "C", "A:B", "A:C", "B:C"), 1):
        for j, a in enumerate(("y1", "y2")):
            v = got[a, t]
            assert v.effect == pytest.approx(beta[i, j], abs=1e-9) and v.standard_error == pytest.approx(np.sqrt(s2[j] * inverse[i, i]))
            p[a, t] = D.t_two_sided(abs(beta[i, j]) / np.sqrt(s2[j] * inverse[i, i]), 17)
            assert v.p_value == pytest.approx(p[a, t], abs=1e-9)
    assert got["y1", "A"].significant and not got["y2", "A"].significant
    # two names of one factor cannot be told apart
    twice = S.relate_designed(df.withColumn("A2", df["A"]), ["y1"], ["A", "A2", "B"]).collect()
    assert {v.term for v in twice} == {"B"}
    with pytest.raises(ValueError):
        S.relate_designed(df, ["y1"], ["A"], "cubic")
