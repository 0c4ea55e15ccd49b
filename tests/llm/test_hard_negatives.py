"""Hard negatives against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row long, cell int, place string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 2, "x") for i, v, y in rows], SCHEMA)


def plain(rows, step=5, k=5, m=5, low=80, high=100, factor=256):
    use = [(i, [int(np.floor(factor * float(np.float32(c)))) for c in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for a, (i, v, y) in enumerate(use):
        if i % step:
            continue
        scores = [(-sum(p * q for p, q in zip(v, w)), j, z) for b, (j, w, z) in enumerate(use) if b != a]
        for s, j, _ in sorted((x for x in scores if x[2] == y))[:k]:
            ok = sorted(x for x in scores if x[2] != y and low * -s <= 100 * -x[0] <= high * -s)[:m]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(ok)]
    return sorted(out)


def check(spark, rows, step=5, **index):
    got = sorted(tuple(r) for r in H.mine(table(spark, rows), F.col("vec_id") % step == 0, **index).collect())
    assert got == plain(rows, step)
    return got


def test_all_pairs(spark):
    draw = np.random.default_rng(3)
    v = draw.standard_normal((400, 6))
    v[200:280] = v[7] + 0.01 * draw.standard_normal((80, 6))
    v[280:320] = v[8]
    rows = [(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, draw.integers(0, 4, 400)))]
    assert len(check(spark, rows, block_rows=40, cells=6)) > 500


def test_chunks_of_queries(spark, monkeypatch):
    draw = np.random.default_rng(4)
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(draw.standard_normal((120, 4)))]
    monkeypatch.setattr(H.Index.chunks, "__defaults__", (16 * 4 * 40,))
    check(spark, rows, step=2, block_rows=30)


def test_odd_tables(spark):
    assert H.mine(table(spark, []), F.lit(True)).count() == 0
    one = [(i, [1.0, float(i)], 1) for i in range(10)]
    assert H.mine(table(spark, one), F.lit(True)).count() == 0
    nan, inf = float("nan"), float("inf")
    odd = [(0, [1.0, 2.0], 0), (1, [nan, 1.0], 0), (2, [inf, 1.0], 1), (3, None, 1), (4, [1.0, 2.0], None), (None, [1.0, 2.0], 0), (5, [None, 2.0], 0), (6, [1.0, 2.0], 0), (6, [1.0, 2.0], 1), (6, [1.0], 1), (7, [1.0, 1.9], 1), (8, [], 1), (5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1)]
    assert check(spark, odd)


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**18 + i), float(-(2**17) + 3 * i)], i % 2) for i in range(40)]
    check(spark, rows)
    held = H.mine(table(spark, [(i, [1e30], i % 2) for i in range(6)]), F.col("vec_id") == 0).collect()
    assert {r["positive_score"] for r in held} == {H.BOUND**2}


def test_node_bounds_hold():
    draw = np.random.default_rng(6)
    x, y = draw.integers(-200, 200, (300, 5)), np.zeros(300, int)
    t = H.Tree(x, y, 16)
    assert sorted(t.order) == list(range(300))
    for k in range(len(t.first)):
        own = x[t.order[t.first[k] : t.last[k]]]
        assert np.sqrt(((own - t.centre[k]) ** 2).sum(1)).max() <= t.radius[k] + 1e-9


@pytest.mark.parametrize("score", [-501, -500, -1, 0, 1, 99, 100, 124, 125, 10**15])
def test_shares_in_whole_numbers(spark, score):
    df = spark.range(1).select(H.floor_share(80, F.lit(score).cast("long")).alias("low"), (-H.floor_share(80, -F.lit(score).cast("long"))).alias("up"))
    assert tuple(df.first()) == (80 * score // 100, -(-80 * score // 100))
