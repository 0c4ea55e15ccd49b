"""Kernel models of several responses: fixed points, blocks, channels and streams."""

import numpy as np
import pandas as pd
import pytest

from millrace.operators.latent import PLS
from millrace.streaming.kernels import KernelPLS, adaptive_pls


def made(seed, n=400, drift=0.0):
    r = np.random.default_rng(seed)
    t = r.normal(size=(n, 2))
    x = t @ r.normal(size=(2, 4)) + 0.1 * r.normal(size=(n, 4)) + 3
    y = t @ np.array([[1.0, 0.5], [-0.5, 2.0]]) + 0.1 * r.normal(size=(n, 2)) + drift * np.arange(n)[:, None] / n
    return x, y


def test_without_forgetting_it_stays_the_training_model():
    x, y = made(1)
    model = KernelPLS(x[:200], y[:200], 2, memory=1, center_memory=1, scale_memory=1)
    z = np.hstack([x, y])[:200]
    plain = PLS.of_products(200, z.sum(0), z.T @ z, list("abcd"), ["p", "q"], 2)
    got = model.update_block(x[200:], y[200:])
    assert np.allclose(got[["hat0", "hat1"]], (x[200:] - plain.center[:4]) @ plain.beta + plain.center[4:])
    assert np.allclose(got["overlap"], 2) and got["in_control"].mean() > 0.8 and model.drift() == (0.0, 0.0)


def test_blocks_are_rows_and_channels_add_up():
    x, y = made(2)
    a, b = (KernelPLS(x[:100], y[:100], 2, memory=0.97, gamma=0.2) for _ in range(2))
    y[150:160] = np.nan
    block = a.update_block(x[100:200], y[100:200])
    rows = [b.update(u, v) for u, v in zip(x[100:200], y[100:200])]
    assert np.allclose(block[["hat0", "hat1"]], [r[0] for r in rows]) and block["in_control"].tolist() == [r[3] for r in rows]
    assert np.allclose(a.xx, b.xx) and np.isclose(np.trace(a.xx), a.size_xx)
    assert np.allclose(sum(a.channels(x[300])), a.predict(x[300]))
    assert a.drift()[0] > 0 and a.overlap() < 2 + 1e-9
    before = a.xy.copy()
    a.update(x[301])
    assert np.allclose(before, a.xy)
    kept = a.xx.copy()
    a.update(x[302] + 100)
    assert np.allclose(kept, a.xx)


def test_it_follows_a_drift_and_passes_over_gaps():
    x, y = made(3, drift=6.0)
    moving, fixed = (KernelPLS(x[:100], y[:100], 2, memory=m, center_memory=m, scale_memory=m) for m in (0.95, 1.0))
    error = [np.abs(m.update_block(x[100:], y[100:])[["hat0", "hat1"]].to_numpy()[-100:] - y[-100:]).mean() for m in (moving, fixed)]
    assert error[0] < 0.5 * error[1]
    row = x[5].copy()
    whole = moving.predict(row)
    row[0] = np.nan
    assert np.abs(moving.predict(row) - whole).max() < 1.5
    assert not moving.update(np.full(4, np.nan))[3]
    for bad in (dict(memory=1.5), dict(gamma=-1)):
        with pytest.raises(ValueError):
            KernelPLS(x, y, 2, **bad)


def test_a_stream_agrees_with_the_loop(spark, tmp_path):
    data = []
    for key in (1, 2):
        x, y = made(10 + key, 90)
        x[3, 1] = np.nan
        data += [(key, i, *map(float, u), *map(float, v)) for i, (u, v) in enumerate(zip(x, y))]
    schema = "k long, t long, a double, b double, c double, d double, p double, q double"
    for part in range(3):  # one file a micro-batch, each later in time than the one before
        spark.createDataFrame([r for r in data if part * 30 <= r[1] < part * 30 + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = adaptive_pls(source, "k", "t", list("abcd"), ["p", "q"], 2, warm=30, memory=0.98)
    query = out.writeStream.format("memory").queryName("kernel_test").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("kernel_test").toPandas().sort_values(["k", "t"])
    for key in (1, 2):
        rows = pd.DataFrame([r for r in data if r[0] == key]).to_numpy()
        clean = [i for i in range(90) if not np.isnan(rows[i]).any()][:30]
        model = KernelPLS(rows[clean, 2:6], rows[clean, 6:], 2, memory=0.98)
        want = model.update_block(rows[clean[-1] + 1 :, 2:6], rows[clean[-1] + 1 :, 6:])
        own = got[got["k"] == key]
        assert own["p_hat"].isna().sum() == clean[-1] + 1
        assert np.allclose(own[["p_hat", "q_hat", "spe", "overlap"]].to_numpy(float)[clean[-1] + 1 :], want[["hat0", "hat1", "spe", "overlap"]])
