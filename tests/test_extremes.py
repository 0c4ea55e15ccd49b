"""Extreme studentised deviates against removal one by one."""

import numpy as np
import pytest

from millrace.operators import extremes, latent, univariate


def table(spark, groups):
    return spark.createDataFrame([(g, i, None if v is None else float(v)) for g, x in groups.items() for i, v in enumerate(x)], "g string, i long, x double").repartition(5)


def expected(groups, most, alpha=0.05):
    return sorted((g, p, r, c, o) for g, x in groups.items() for p, r, c, o in univariate.esd_of(np.array([v for v in x if v is not None], float), most, alpha))


@pytest.mark.parametrize("most", [1, 3, 8, 40])
def test_removals_of_groups(spark, most):
    r = np.random.default_rng(1)
    groups = {"a": np.append(r.normal(size=200), [9, -8, 7.5]), "b": r.exponential(size=30), "c": r.normal(size=5), "d": [1.0, 2.0], "e": [3.0] * 12, "f": [*([1.0, 2.0, 3.0] * 10), 50.0, 50.0]}
    got = sorted(tuple(v) for v in univariate.detect_outliers_esd(table(spark, groups), "x", "i", ["g"], most).collect())
    want = expected(groups, most)
    # where values tie, any of the rows may go
    assert [v[0] for v in got] == [v[0] for v in want]
    for g in groups:
        own, plain = [[v for v in rows if v[0] == g] for rows in (got, want)]
        values = lambda rows, g=g: sorted(float(groups[g][v[1]]) for v in rows)
        assert values(own) == values(plain) and values([v for v in own if v[4]]) == values([v for v in plain if v[4]])
        assert np.allclose(sorted(v[2] for v in own), sorted(v[2] for v in plain)) and np.allclose(sorted(v[3] for v in own), sorted(v[3] for v in plain))


def test_one_group_nulls_and_huge_outliers(spark):
    r = np.random.default_rng(2)
    x = [*r.normal(size=50), 1e12, -3e12, float("nan"), None, *r.normal(size=50)]
    got = univariate.detect_outliers_esd(table(spark, {"a": x}), "x", "i", most=4).collect()
    kept = [v for v in x if v is not None and v == v]
    want = univariate.esd_of(np.array(kept), 4)
    assert sorted(v.position for v in got if v.outlier) == [50, 51]
    # removing one by one from whole sums, the small deviates keep their digits
    assert np.allclose(sorted(v.statistic for v in got), sorted(w[1] for w in want), rtol=1e-9)
    assert univariate.detect_outliers_esd(table(spark, {}), "x", "i", ["g"], 2).count() == 0


def test_cut_offs_agree_with_removals(spark):
    r = np.random.default_rng(3)
    x = np.append(r.exponential(size=300), [25, 26, 27, 27, 30])
    low, high = extremes.cut_offs(table(spark, {"a": x}), "x", 60)
    flagged = {p for p, *_, o in univariate.esd_of(x, 60) if o}
    assert flagged == {i for i, v in enumerate(x) if v <= low or v >= high} and len(flagged) >= 5
    assert extremes.cut_offs(table(spark, {"a": [1, 2]}), "x", 1) == (-np.inf, np.inf)


def test_outliers_of_models(spark):
    r = np.random.default_rng(4)
    t = r.normal(size=(120, 2))
    x = t @ r.normal(size=(2, 5)) + 0.05 * r.normal(size=(120, 5))
    x[7] += 3 * r.normal(size=5)
    x[30] = 8 * x[30]
    x -= x.mean(0)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double, d double, e double")
    model = latent.PCA.fit(df, list("abcde"), 2)
    rows = model.diagnose(df).toPandas().sort_values("id")
    got = {v.id: v for v in model.detect_outliers(df).collect()}
    want = {}
    for name, limit in (("hotellings_t2", model.t2_limit()), ("spe", model.spe_limit())):
        values = rows[name].to_numpy()
        for i in set(np.flatnonzero(values > limit)) | {p for p, *_, o in univariate.esd_of(values, 24, 1 - 0.95) if o}:
            want.setdefault(int(i), []).append(name)
    assert {k: v.outlier_types for k, v in got.items()} == want and 7 in got and 30 in got
    assert got[7].severity == pytest.approx(max(rows["spe"][7] / model.spe_limit(), rows["hotellings_t2"][7] / model.t2_limit()))


def test_ranks_with_many_ties(spark, monkeypatch):
    r = np.random.default_rng(5)
    groups = {"a": [*r.integers(0, 5, 300), *[7.0] * 200], "b": r.normal(size=50)}
    x = table(spark, groups).select("g", "x")
    monkeypatch.setattr(univariate, "TIES", 64)
    for g in groups:
        own = [v for v in univariate.ranked(x, ["g"]).collect() if v.g == g]
        assert [v.x for v in sorted(own, key=lambda v: v.rank)] == sorted(groups[g]) and sorted(v.rank for v in own) == list(range(1, len(groups[g]) + 1))
    fit = univariate.distribution_fit(x, "x", ["g"]).collect()
    for v in fit:
        own = np.sort(groups[v.g])
        from math import erfc, sqrt

        f = np.array([erfc(-(u - own.mean()) / own.std() / sqrt(2)) / 2 for u in own])
        n = len(own)
        assert v.distance == pytest.approx(max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max()))


@pytest.mark.parametrize("most", [1, 5, 60, 200, 400])
def test_cut_offs_of_ties_sort_no_rows(spark, monkeypatch, most):
    monkeypatch.setattr(extremes, "_extremes", None)
    r = np.random.default_rng(6)
    for x in (np.append(np.round(r.exponential(size=300), 1), [25, 26, 27, 27, 30, -9]), np.append(r.integers(0, 3, 300), [9.0, 9.0]), np.append([4.0] * 300, [5.0])):
        low, high = extremes.cut_offs(table(spark, {"a": x}), "x", most)
        flagged = {float(x[p]) for p, *_, o in univariate.esd_of(x, most) if o}
        assert flagged == {float(v) for v in x if v <= low or v >= high}


def test_cut_offs_of_columns_share_their_passes(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = np.column_stack([np.append(r.exponential(size=397), [25, 26, 27]), np.append(r.normal(size=398), [-40, np.nan]), np.append(r.integers(0, 3, 399), 9.0)])
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
    tables, plain = [], extremes.written
    monkeypatch.setattr(extremes, "written", lambda d: tables.append(d) or plain(d))
    for most in (5, 120, 300):
        tables.clear()
        for c, (low, high) in zip("abc", extremes.cut_offs_of(df, list("abc"), most), strict=True):
            v = x[:, "abc".index(c)]
            v = v[~np.isnan(v)]
            assert {float(v[p]) for p, *_, o in univariate.esd_of(v, most) if o} == {float(u) for u in v if u <= low or u >= high}
        # the counts of all ends are one table, and the rows are not written again
        assert len(tables) == (most < 200)


def test_last_of_the_outliers_is_found_in_few_steps(monkeypatch):
    r, n, most = np.random.default_rng(9), 2_000, 600
    tried, plain = [], extremes.critical
    monkeypatch.setattr(extremes, "critical", lambda *a: tried.append(a) or plain(*a))
    limits = np.array([plain(n, i + 1, 0.05) for i in range(most)])
    for last in (0, 1, 299, 600):
        statistics = np.where(np.arange(most) < last - 1, limits + r.uniform(-1, 1, most), limits - 0.5)
        if last:
            statistics[last - 1] = limits[last - 1] + 1e-3
        assert extremes.found(statistics, n, 0.05) == last
    tried.clear()
    # above the last critical value everywhere, above its own nowhere but at the first
    assert extremes.found(np.append(limits[0] + 1, np.full(most - 1, limits[most // 2])), n, 0.05) == most
    assert len(tried) < 30


def test_box_by_counts_of_values(spark, monkeypatch):
    monkeypatch.setattr(univariate, "quantile", None)
    r = np.random.default_rng(7)
    groups = {"a": np.round(r.normal(size=301), 1), "b": r.exponential(size=58), "c": [2.0], "d": [5.0] * 40 + [9.0, 1.0], "e": [None]}
    got = {v.g: v for v in univariate.box_statistics(table(spark, groups), "x", ["g"]).collect()}
    assert sorted(got) == ["a", "b", "c", "d"]
    for g, v in got.items():
        want = np.quantile(groups[g], [0, 0.25, 0.5, 0.75, 1])
        assert [v.low, v.q1, v.q2, v.q3, v.high] == pytest.approx(want)
        assert v.n_outliers == sum(not v.lower_fence <= x <= v.upper_fence for x in groups[g])
