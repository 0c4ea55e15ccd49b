"""Models that follow a stream: one key's state is a small model, updated row by row in order of time within a batch.

A late row is taken when it comes; nothing is held back for it.
"""

from __future__ import annotations

import math
import pickle
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.latent import PLS, positive, spe_limit_of, t2_limit


#: Rows of one key that are in memory at once.
BLOCK = 10_000


def in_order(frames: Iterator[pd.DataFrame], time: str, columns: Sequence[str], block: int = BLOCK) -> Iterator[tuple[pd.Series, np.ndarray]]:
    """Times and cells of a key's rows in the order of time, a block at a time: cells wait in a file, only times and their order are in memory."""
    with tempfile.TemporaryFile() as store:
        times = []
        for f in frames:
            times.append(f[time].reset_index(drop=True))
            store.write(np.ascontiguousarray(f[list(columns)].to_numpy(float)).tobytes())
        store.flush()
        times = pd.concat(times, ignore_index=True)
        order = times.sort_values(kind="stable").index.to_numpy()
        for at in range(0, len(order), block):
            own = order[at : at + block]
            # mapped anew for each block, so that pages of earlier ones are given back
            cells = np.array(np.memmap(store, float, "r", shape=(len(order), len(columns)))[own])
            yield times.iloc[own].reset_index(drop=True), cells


class AdaptivePCA:
    """A principal component model that forgets: centre, scale and kernel move with every row that is in control."""

    def __init__(self, x: np.ndarray, components: int, memory: float = 0.99, conflevel: float = 0.95, buffer: int = 200):
        self.memory, self.conflevel, self.size, self.n = memory, conflevel, buffer, len(x)
        self.center, self.scale = x.mean(axis=0), x.std(axis=0, ddof=1)
        self.scale = np.where(self.scale > 1e-12, self.scale, 1.0)
        z = (x - self.center) / self.scale
        self.kernel = z.T @ z / max(self.n - 1, 1)
        self.components = min(components, x.shape[1])
        self._solve()
        self.spe = list(((z - z @ self.loadings @ self.loadings.T) ** 2).sum(axis=1)[-buffer:])

    def _solve(self) -> None:
        values, vectors = np.linalg.eigh(self.kernel)
        order = np.argsort(values)[::-1][: self.components]
        self.values = np.maximum(values[order], 1e-12)
        new = vectors[:, order]
        before = getattr(self, "loadings", None)
        self.loadings = new * (positive(new) if before is None else np.where((new * before).sum(axis=0) < 0, -1.0, 1.0))

    def project(self, row: np.ndarray) -> tuple[np.ndarray, float, float]:
        z = (row - self.center) / self.scale
        t = z @ self.loadings
        return t, float((t**2 / self.values).sum()), float(((z - self.loadings @ t) ** 2).sum())

    def limits(self) -> tuple[float, float]:
        return t2_limit(self.n, self.components, self.conflevel), spe_limit_of(float(np.mean(self.spe)), float(np.var(self.spe, ddof=1)) if len(self.spe) > 1 else 0.0, self.conflevel)

    def update(self, row: np.ndarray) -> tuple[np.ndarray, float, float, bool]:
        """Scores, T2, SPE and whether the row was in control; only then does the model move, its scale by the old centre first."""
        t, t2, spe = self.project(row)
        most_t2, most_spe = self.limits()
        inside = t2 <= most_t2 and math.sqrt(spe) <= max(most_spe, 1e-12)
        if inside:
            a = self.memory
            self.scale = np.sqrt(a * self.scale**2 + (1 - a) * (row - self.center) ** 2)
            self.center = a * self.center + (1 - a) * row
            z = (row - self.center) / self.scale
            self.kernel = a * self.kernel + (1 - a) * np.outer(z, z)
            self._solve()
            self.spe = [*self.spe, spe][-self.size :]
        return t, t2, math.sqrt(spe), inside


class AdaptivePLS:
    """A projection model that forgets: like AdaptivePCA, with a kernel of x and y that moves when y is known."""

    def __init__(self, x: np.ndarray, y: np.ndarray, components: int, memory: float = 0.99, conflevel: float = 0.95, buffer: int = 200):
        self.memory, self.conflevel, self.size, self.n = memory, conflevel, buffer, len(x)
        self.center, self.scale = x.mean(axis=0), x.std(axis=0, ddof=1)
        self.scale = np.where(self.scale > 1e-12, self.scale, 1.0)
        self.y_center, self.y_scale = float(y.mean()), float(y.std(ddof=1)) or 1.0
        z, v = (x - self.center) / self.scale, (y - self.y_center) / self.y_scale
        self.kernel, self.cross = z.T @ z / (self.n - 1), z.T @ v / (self.n - 1)
        self.components = min(components, x.shape[1])
        self._solve()
        self.first = (self.beta.copy(), self.center.copy(), self.scale.copy(), self.y_center, self.y_scale)
        self.spe = list(((z - z @ self.rotation @ self.loadings.T) ** 2).sum(axis=1)[-buffer:])

    def _solve(self) -> None:
        k = len(self.center)
        model = PLS.of_products(self.n, np.zeros(k + 1), (self.n - 1) * np.block([[self.kernel, self.cross[:, None]], [self.cross[None, :], np.ones((1, 1))]]), [f"x{i}" for i in range(k)], ["y"], self.components, scale=False)
        self.rotation, self.loadings, self.score_scale, self.beta = model.rotation, model.loadings, model.score_scale, model.beta[:, 0]

    def predict(self, row: np.ndarray) -> float:
        return self.y_center + self.y_scale * float((row - self.center) / self.scale @ self.beta)

    def decompose(self, row: np.ndarray) -> dict[str, float]:
        """The prediction as that of the first model, what the moved centre and scale add, and what the moved kernels add."""
        beta, center, scale, y_center, y_scale = self.first
        static = y_center + y_scale * float((row - center) / scale @ beta)
        moved = self.y_center + self.y_scale * float((row - self.center) / self.scale @ beta)
        return {"static": static, "preprocessing": moved - static, "kernel": self.predict(row) - moved}

    def update(self, row: np.ndarray, y: float | None = None) -> tuple[float, float, float, bool]:
        """Prediction, T2, SPE and whether the row was in control; only then does the model move."""
        z = (row - self.center) / self.scale
        t = z @ self.rotation
        t2, spe = float(((t / self.score_scale) ** 2).sum()), float(((z - self.loadings @ t) ** 2).sum())
        hat = self.predict(row)
        limit = spe_limit_of(float(np.mean(self.spe)), float(np.var(self.spe, ddof=1)) if len(self.spe) > 1 else 0.0, self.conflevel)
        inside = t2 <= t2_limit(self.n, self.components, self.conflevel) and math.sqrt(spe) <= max(limit, 1e-12)
        if inside:
            a = self.memory
            self.scale = np.sqrt(a * self.scale**2 + (1 - a) * (row - self.center) ** 2)
            self.center = a * self.center + (1 - a) * row
            z = (row - self.center) / self.scale
            self.kernel = a * self.kernel + (1 - a) * np.outer(z, z)
            if y is not None and not math.isnan(y):
                self.y_scale = math.sqrt(a * self.y_scale**2 + (1 - a) * (y - self.y_center) ** 2)
                self.y_center = a * self.y_center + (1 - a) * y
                self.cross = a * self.cross + (1 - a) * z * (y - self.y_center) / self.y_scale
            self._solve()
            self.spe = [*self.spe, spe][-self.size :]
        return hat, t2, math.sqrt(spe), inside


def subspace_distance(a: np.ndarray, b: np.ndarray) -> float:
    """The sine of the largest angle between the spaces of two sets of loadings."""
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return float(math.sqrt(max(0.0, 1 - np.linalg.svd(qa.T @ qb, compute_uv=False).min() ** 2)))


def adaptive_pca(df: DataFrame, key: str, time: str, columns: Sequence[str], components: int = 2, warm: int = 30, memory: float = 0.99) -> DataFrame:
    """Stateful monitoring of a stream by key: rows up to `warm` train a model, later ones are judged and move it.

    Gives key, time, hotellings_t2, spe, in_control; rows of the warm-up have nulls.
    """
    kinds = dict(df.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, model = pickle.loads(state.get[0]) if state.exists else ([], None)
        for times, cells in in_order(frames, time, columns):
            out = []
            for when, row in zip(times, cells, strict=True):
                if np.isnan(row).any():
                    out.append((k[0], when, None, None, None))
                elif model is None:
                    waiting.append(row)
                    out.append((k[0], when, None, None, None))
                    if len(waiting) >= warm:
                        model, waiting = AdaptivePCA(np.array(waiting), components, memory), []
                else:
                    _, t2, spe, inside = model.update(row)
                    out.append((k[0], when, t2, spe, inside))
            yield pd.DataFrame(out, columns=[key, time, "hotellings_t2", "spe", "in_control"])
        state.update((pickle.dumps((waiting, model)),))

    schema = f"`{key}` {kinds[key]}, `{time}` {kinds[time]}, hotellings_t2 double, spe double, in_control boolean"
    return df.select(key, time, *columns).groupBy(key).applyInPandasWithState(step, schema, "model binary", "append", GroupStateTimeout.NoTimeout)


def windowed_shewhart(df: DataFrame, key: str, time: str, value: str, target: float, sigma: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Means of time windows against three-sigma limits for their counts; windows close when the watermark passes."""
    out = df.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    half = 3 * sigma / F.sqrt("n")
    return out.select(key, F.col("window.start").alias("start"), "n", "mean", (F.abs(F.col("mean") - target) > half).alias("out_of_control"))
