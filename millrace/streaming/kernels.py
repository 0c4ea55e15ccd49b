"""A projection model of several responses that follows a stream by its kernels X'X and X'Y.

Centre and scale move by their own memories, kernels by theirs; a part of the
training kernels may be put back with every row (`gamma`), and kernels keep the
size they had in training.  A row out of control moves nothing; one without
responses moves the part of x alone; missing cells of x are passed over.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.latent import PLS, spe_limit_of, t2_limit
from millrace.streaming.adaptive import in_order


def nuclear(m: np.ndarray) -> float:
    return float(np.linalg.svd(m, compute_uv=False).sum())


class KernelPLS:
    def __init__(self, x: np.ndarray, y: np.ndarray, components: int, memory: float = 0.99, center_memory: float = 0.99, scale_memory: float = 0.99, gamma: float = 0.0, conflevel: float = 0.95):
        y = y.reshape(len(x), -1)
        if not all(0 <= m <= 1 for m in (memory, center_memory, scale_memory)) or gamma < 0:
            raise ValueError("memories lie within [0, 1], and gamma is not negative")
        self.memory, self.center_memory, self.scale_memory, self.gamma, self.n = memory, center_memory, scale_memory, gamma, len(x)
        usable = lambda s: np.where(s > 1e-12, s, 1.0)
        self.center, self.scale = x.mean(0), usable(x.std(0, ddof=1))
        self.y_center, self.y_scale = y.mean(0), usable(y.std(0, ddof=1))
        z, v = (x - self.center) / self.scale, (y - self.y_center) / self.y_scale
        self.xx, self.xy = z.T @ z, z.T @ v
        self.xx0, self.xy0, self.size_xx, self.size_xy = self.xx, self.xy, float(np.trace(self.xx)), nuclear(self.xy)
        self.components, self.loadings = min(components, x.shape[1]), None
        self._solve()
        self.first = (self.beta, self.center, self.scale, self.y_center, self.y_scale, np.linalg.qr(self.weights)[0])
        spe = ((z - z @ self.rotation @ self.loadings.T) ** 2).sum(1)
        self.spe_limit = spe_limit_of(float(spe.mean()), float(spe.var(ddof=1)), conflevel)
        self.t2_limit = t2_limit(self.n, self.rotation.shape[1], conflevel)

    def _solve(self) -> None:
        k, m = self.xy.shape
        model = PLS.of_products(self.n, np.zeros(k + m), np.block([[self.xx, self.xy], [self.xy.T, (self.n - 1) * np.eye(m)]]), [f"x{i}" for i in range(k)], [f"y{i}" for i in range(m)], self.components, scale=False)
        signs = np.ones(model.components)
        if self.loadings is not None and self.loadings.shape == model.loadings.shape:
            signs = np.where((model.loadings * self.loadings).sum(0) < 0, -1.0, 1.0)
        self.weights, self.loadings, self.rotation = model.weights * signs, model.loadings * signs, model.rotation * signs
        self.y_loadings, self.score_scale = model.y_loadings * signs, model.score_scale
        self.beta = self.rotation @ self.y_loadings.T

    def project(self, row: np.ndarray) -> tuple[np.ndarray, float, float]:
        """Scores, T2 and SPE (a root) of a row; missing cells are passed over, component after component."""
        z = (row - self.center) / self.scale
        known = ~np.isnan(z)
        left = np.where(known, z, 0.0)
        if known.all():
            t = z @ self.rotation
            left = z - self.loadings @ t
        else:
            t = np.zeros(self.rotation.shape[1])
            for a in range(len(t)):
                w = np.where(known, self.weights[:, a], 0.0)
                t[a] = left @ w / max(w @ w, 1e-300)
                left = left - t[a] * np.where(known, self.loadings[:, a], 0.0)
        return t, float(((t / np.maximum(self.score_scale, 1e-300)) ** 2).sum()), math.sqrt(float(left @ left))

    def predict(self, row: np.ndarray) -> np.ndarray:
        return self.project(row)[0] @ self.y_loadings.T * self.y_scale + self.y_center

    def channels(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The prediction as that of the training model, what moved centres and scales add, and what moved kernels add; missing cells count as centres."""
        beta, center, scale, y_center, y_scale, _ = self.first
        now = np.nan_to_num((row - self.center) / self.scale)
        static = y_center + y_scale * (np.nan_to_num((row - center) / scale) @ beta)
        moved = self.y_center + self.y_scale * (now @ beta)
        return static, moved - static, self.y_center + self.y_scale * (now @ self.beta) - moved

    def overlap(self) -> float:
        """How much of the space of the training weights the present ones span, in components."""
        cross = self.first[5].T @ np.linalg.qr(self.weights)[0]
        return float((cross**2).sum())

    def drift(self) -> tuple[float, float]:
        """How far the centre has moved, in training scales, and the mean relative change of the scales."""
        _, center, scale, *_ = self.first
        return float(np.linalg.norm((self.center - center) / scale)), float(np.abs(self.scale / scale - 1).mean())

    def update(self, row: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, float, float, bool]:
        """Prediction, T2, SPE and whether the row was in control, all before the model moves."""
        t, t2, spe = self.project(row)
        hat = t @ self.y_loadings.T * self.y_scale + self.y_center
        inside = bool(t2 <= self.t2_limit and spe <= max(self.spe_limit, 1e-12) and not np.isnan(row).all())
        if inside:
            known = ~np.isnan(row)
            self.center, self.scale = _moved(self.center, self.scale, np.where(known, row, self.center), self.center_memory, self.scale_memory, known)
            z, v = np.nan_to_num((row - self.center) / self.scale), None
            if y is not None and not np.isnan(y).any():
                self.y_center, self.y_scale = _moved(self.y_center, self.y_scale, y, self.center_memory, self.scale_memory, np.ones(len(y), bool))
                v = (y - self.y_center) / self.y_scale
            self.xx = self._kernel(self.xx, np.outer(z, z), self.xx0, self.size_xx, lambda m: float(np.trace(m)))
            if v is not None:
                self.xy = self._kernel(self.xy, np.outer(z, v), self.xy0, self.size_xy, nuclear)
            self._solve()
        return hat, t2, spe, inside

    def _kernel(self, kernel: np.ndarray, own: np.ndarray, first: np.ndarray, size: float, norm) -> np.ndarray:
        if not size > 0:
            return kernel
        own = (1 - self.memory) * own
        new = self.memory * kernel + own + self.gamma * norm(own) / size * first
        return new * (size / norm(new)) if norm(new) > 1e-12 else new

    def update_block(self, x: np.ndarray, y: np.ndarray | None = None) -> pd.DataFrame:
        """Rows in their order; y may have NaN rows, which are not known yet."""
        out = []
        for i, row in enumerate(x):
            hat, t2, spe, inside = self.update(row, None if y is None else np.atleast_1d(y[i]))
            out.append((*hat, t2, spe, inside, self.overlap()))
        return pd.DataFrame(out, columns=[*(f"hat{k}" for k in range(len(self.y_center))), "hotellings_t2", "spe", "in_control", "overlap"])


def _moved(center: np.ndarray, scale: np.ndarray, row: np.ndarray, center_memory: float, scale_memory: float, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scale moves by the old centre first; what is unknown stays."""
    new = np.sqrt(scale_memory * scale**2 + (1 - scale_memory) * (row - center) ** 2)
    return np.where(known, center_memory * center + (1 - center_memory) * row, center), np.where(known, np.where(new > 1e-12, new, 1.0), scale)


def adaptive_pls(df: DataFrame, key: str, time: str, x: Sequence[str], y: Sequence[str], components: int = 2, warm: int = 30, **how: float) -> DataFrame:
    """A model a key over a stream: whole rows up to `warm` train it, later ones are predicted, judged, and move it.

    Gives key, time, each response as predicted (<name>_hat), hotellings_t2, spe,
    in_control and overlap; rows of the warm-up have nulls.  Rows of a
    micro-batch are taken in the order of time, a block at a time from a file.
    """
    kinds, x, y = dict(df.dtypes), list(x), list(y)
    names = [*(f"{c}_hat" for c in y), "hotellings_t2", "spe", "in_control", "overlap"]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, model = pickle.loads(state.get[0]) if state.exists else ([], None)
        for times, data in in_order(frames, time, [*x, *y]):
            at = 0
            while model is None and at < len(data):
                if not np.isnan(data[at]).any():
                    waiting.append(data[at])
                at += 1
                if len(waiting) >= warm:
                    rows = np.array(waiting)
                    model, waiting = KernelPLS(rows[:, : len(x)], rows[:, len(x) :], components, **how), []
            out = pd.DataFrame({key: k[0], time: times, **{n: pd.Series([None] * len(times), dtype="boolean" if n == "in_control" else "float64") for n in names}})
            if model is not None and at < len(data):
                found = model.update_block(data[at:, : len(x)], data[at:, len(x) :])
                for n, c in zip(names, found.columns, strict=True):
                    out.loc[at:, n] = found[c].to_numpy()
            yield out
        state.update((pickle.dumps((waiting, model)),))

    schema = ", ".join([f"`{key}` {kinds[key]}, `{time}` {kinds[time]}", *(f"`{n}` {'boolean' if n == 'in_control' else 'double'}" for n in names)])
    return df.select(key, time, *x, *y).groupBy(key).applyInPandasWithState(step, schema, "model binary", "append", GroupStateTimeout.NoTimeout)
