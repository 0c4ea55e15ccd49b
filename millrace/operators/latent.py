"""Latent-variable models: principal components, projection to latent structures, and their orthogonal form.

Columns are few (up to some thousands), rows are many: a fit is the cross
products of one pass, a small decomposition on the driver, and, for the training
limits, one pass of sums of the diagnostics.  Scores, Hotelling's T2, squared
prediction errors, contributions and predictions are projections over arrays,
without a shuffle.  Rows with missing values are left out of the cross products;
for PCA `fit_missing` iterates over all known cells instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.functions import distributions as D
from millrace.operators.linear import gram, moments
from millrace.operators.resampling import grouped_moments
from millrace.operators.scaling import TINY
from millrace.sources.tables import written


def t2_limit(n: int, components: int, conflevel: float = 0.95) -> float:
    """A (N - 1)(N + 1) / (N (N - A)) F."""
    if n <= components:
        return math.inf
    return components * (n - 1) * (n + 1) / (n * (n - components)) * D.f_ppf(conflevel, components, n - components)


def spe_limit_of(mean: float, variance: float, conflevel: float = 0.95) -> float:
    """The root of g chi2(h), matched to the mean and variance of squared prediction errors."""
    if not variance > 0 or not mean > 0:
        return math.sqrt(max(mean, 0.0))
    g, h = variance / (2 * mean), 2 * mean**2 / variance
    return math.sqrt(g * D.chi2_ppf(conflevel, h))


def positive(loadings: np.ndarray) -> np.ndarray:
    """Signs that make each column's largest loading positive, the first of those that differ only by rounding."""
    size = np.abs(loadings)
    return np.where(loadings[(size >= (1 - 1e-9) * size.max(axis=0)).argmax(axis=0), np.arange(loadings.shape[1])] < 0, -1.0, 1.0)


def over_rows(df: DataFrame, columns: Sequence[str], names: Sequence[str], run) -> DataFrame:
    """df and columns that run(matrix of the columns) gives, NaN where a value is missing."""
    at = [df.columns.index(c) for c in columns]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in at]) if b.num_rows else np.zeros((0, len(at)))
            out = run(x)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(out[:, k])) for k in range(len(names)))], [*b.schema.names, *names])

    return df.mapInArrow(each, StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in names)]))


#: Outliers that deviates are asked for at most, where the caller names no number.
MOST_OUTLIERS = 100_000


def flagged(rows: DataFrame, t2_limit: float, spe_limit: float, alpha: float, most: int | None = None) -> DataFrame:
    """Rows whose hotellings_t2 or spe is beyond its limit, or an outlier of all rows by generalised extreme studentised deviates.

    outlier_types says by which of the two, severity is the larger ratio to its
    limit.  At most `most` outliers of each are asked for (a fifth of the rows,
    up to MOST_OUTLIERS, if none is named); rows that tie with one count too.
    """
    from millrace.operators.extremes import cut_offs_of

    rows = written(rows)
    most = max(1, min(rows.count() // 5, MOST_OUTLIERS)) if most is None else most
    limits = {"hotellings_t2": t2_limit, "spe": spe_limit}
    beyond = {name: (F.col(name) > limits[name]) | (F.col(name) <= low) | (F.col(name) >= high) for name, (low, high) in zip(limits, cut_offs_of(rows, list(limits), most, alpha), strict=True)}
    severity = F.greatest(F.col("hotellings_t2") / t2_limit, F.col("spe") / (spe_limit if spe_limit > 0 else math.inf))
    types = F.filter(F.array(*(F.when(b, name) for name, b in beyond.items())), lambda x: x.isNotNull())
    return rows.filter(beyond["hotellings_t2"] | beyond["spe"]).withColumn("outlier_types", types).withColumn("severity", severity)


@dataclass
class PCA:
    """Principal components of columns as they are: neither centred nor scaled here."""

    columns: list[str]
    loadings: np.ndarray
    score_scale: np.ndarray
    n: int
    r2_cumulative: np.ndarray
    r2_per_variable: np.ndarray
    spe_moments: tuple[float, float] = (0.0, 0.0)

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], components: int) -> PCA:
        columns = list(columns)
        n, _, products = gram(df, columns)
        components = min(components, len(columns), n)
        # scaled columns have one sum of squares, n - 1; what rounding adds would turn components of weak correlations
        own = np.diag(products)
        if len(own) and own.max() > 0 and np.abs(own - (n - 1)).max() < 1e-9 * n:
            np.fill_diagonal(products, n - 1)
        values, vectors = np.linalg.eigh(products)
        order = np.argsort(values)[::-1][:components]
        values, vectors = np.maximum(values[order], 0), vectors[:, order]
        vectors = vectors * positive(vectors)
        explained = np.cumsum(vectors**2 * values, axis=1)
        own = np.diag(products)
        out = cls(columns, vectors, np.sqrt(values / max(n - 1, 1)), n, np.cumsum(values) / own.sum(), np.divide(explained, own[:, None], out=np.zeros_like(explained), where=own[:, None] > 0))
        row = out.diagnose(df.select(*columns).dropna()).agg(F.avg(F.col("spe") ** 2), F.var_samp(F.col("spe") ** 2)).first()
        out.spe_moments = (row[0] or 0.0, row[1] or 0.0)
        return out

    @property
    def components(self) -> int:
        return self.loadings.shape[1]

    def _of(self, x: np.ndarray) -> np.ndarray:
        t = x @ self.loadings
        scaled = np.divide(t, self.score_scale, out=np.zeros_like(t), where=self.score_scale > 0)
        return np.column_stack([t, (scaled**2).sum(axis=1), np.sqrt(((x - t @ self.loadings.T) ** 2).sum(axis=1))])

    def diagnose(self, df: DataFrame) -> DataFrame:
        """Scores t1.., hotellings_t2 over all components, and spe, the root of the squared prediction error."""
        return over_rows(df, self.columns, [*(f"t{a + 1}" for a in range(self.components)), "hotellings_t2", "spe"], self._of)

    def transform(self, df: DataFrame) -> DataFrame:
        return over_rows(df, self.columns, [f"t{a + 1}" for a in range(self.components)], lambda x: x @ self.loadings)

    def names_out(self) -> list[str]:
        return [f"t{a + 1}" for a in range(self.components)]

    def reconstruct(self, df: DataFrame) -> DataFrame:
        """df and each column as the components tell it."""
        return over_rows(df, self.columns, [f"{c}_hat" for c in self.columns], lambda x: x @ self.loadings @ self.loadings.T)

    def score(self, df: DataFrame) -> float:
        """The share of the sum of squares of df that the components tell; one aggregate."""
        row = self.diagnose(df.dropna(subset=self.columns)).agg(F.sum(F.col("spe") ** 2), *(F.sum(F.col(c).cast("double") ** 2) for c in self.columns)).first()
        whole = sum(v or 0.0 for v in row[1:])
        return 1 - (row[0] or 0.0) / whole if whole > 0 else math.nan

    def t2_limit(self, conflevel: float = 0.95) -> float:
        return t2_limit(self.n, self.components, conflevel)

    def spe_limit(self, conflevel: float = 0.95) -> float:
        return spe_limit_of(*self.spe_moments, conflevel)

    def score_limit(self, component: int, conflevel: float = 0.95) -> float:
        return D.t_ppf(0.5 + conflevel / 2, self.n - 1) * float(self.score_scale[component - 1])

    def detect_outliers(self, df: DataFrame, conflevel: float = 0.95, most: int | None = None) -> DataFrame:
        """Rows beyond a limit, or unusual among the others by extreme studentised deviates of T2 or SPE (see `flagged`)."""
        return flagged(self.diagnose(df), self.t2_limit(conflevel), self.spe_limit(conflevel), 1 - conflevel, most)

    def t2_contributions(self, df: DataFrame) -> DataFrame:
        weights = self.loadings / np.where(self.score_scale > 0, self.score_scale, np.inf) ** 2
        return over_rows(df, self.columns, [f"{c}_t2" for c in self.columns], lambda x: x * ((x @ self.loadings) @ (weights.T)))

    def spe_contributions(self, df: DataFrame) -> DataFrame:
        """Signed residuals."""
        return over_rows(df, self.columns, [f"{c}_spe" for c in self.columns], lambda x: x - x @ self.loadings @ self.loadings.T)

    def score_contributions(self, df: DataFrame, component: int) -> DataFrame:
        return over_rows(df, self.columns, [f"{c}_t{component}" for c in self.columns], lambda x: x * self.loadings[:, component - 1])

    def squared_cosine(self, df: DataFrame) -> DataFrame:
        def run(x: np.ndarray) -> np.ndarray:
            t = x @ self.loadings
            whole = (x**2).sum(axis=1, keepdims=True)
            return np.divide(t**2, whole, out=np.zeros_like(t), where=whole > 0)

        return over_rows(df, self.columns, [f"cos2_{a + 1}" for a in range(self.components)], run)

    def eigenvalues(self) -> list[tuple[int, float, float, float]]:
        """Component, eigenvalue, per cent, cumulative per cent."""
        share = np.diff(self.r2_cumulative, prepend=0)
        return [(a + 1, float(self.score_scale[a] ** 2), 100 * float(share[a]), 100 * float(self.r2_cumulative[a])) for a in range(self.components)]

    def ellipse(self, a: int = 1, b: int = 2, conflevel: float = 0.95, points: int = 100) -> np.ndarray:
        reach = math.sqrt(t2_limit(self.n, self.components, conflevel))
        angle = np.linspace(0, 2 * np.pi, points)
        return np.column_stack([reach * self.score_scale[a - 1] * np.cos(angle), reach * self.score_scale[b - 1] * np.sin(angle)])


#: Columns up to which known and missing cells make few patterns (2 ** 8).
PATTERN_COLUMNS = 8


def pattern_products(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The patterns of known cells (True) that rows of k columns have, and of each the sums of products of the cells, missing ones 0; one pass."""
    powers = 1 << np.arange(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << k, k, k))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            known = ~np.isnan(x)
            which = known @ powers
            order = np.argsort(which, kind="stable")
            found, at = np.unique(which[order], return_index=True)
            for p, own in zip(found, np.split(np.where(known, x, 0.0)[order], at[1:]), strict=True):
                total[p] += own.T @ own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "x"])

    out = np.zeros(k * k << k)
    for r in rows.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    out = out.reshape(1 << k, k, k)
    seen = np.flatnonzero(out.any(axis=(1, 2)))
    return (seen[:, None] & powers) > 0, out[seen]


def fit_missing(df: DataFrame, columns: Sequence[str], components: int, most: int = 100, tolerance: float = 1e-8) -> PCA:
    """PCA by alternating least squares over known cells, one component after another.

    Given loadings, a row's score needs only that row; given the scores, the new
    loadings are sums over rows.  Scores and what they leave are linear in a row,
    by a matrix that rows with the same known cells share: up to PATTERN_COLUMNS
    columns, one pass sums the products of each such pattern, and iterations are
    products of small matrices.  With more columns, patterns may be as many as
    rows; then each iteration is one pass, and only K pairs of sums leave the
    tasks.
    """
    columns, done, scales, r2 = list(columns), [], [], []
    k = len(columns)
    rows = written(df.select(*(F.col(c).cast("double").alias(c) for c in columns)))  # read by every pass
    whole = rows.agg(F.count(F.lit(1)), *(F.sum(F.col(c) * F.col(c)) for c in columns)).first()
    n, own = whole[0], np.array([x or 0.0 for x in whole[1:]])

    def deflated(x: np.ndarray, known: np.ndarray) -> np.ndarray:
        x = np.where(known, x, 0.0)
        for p in done:
            t = (x @ p) / np.maximum(known @ p**2, TINY)
            x = np.where(known, x - np.outer(t, p), 0.0)
        return x

    if k <= PATTERN_COLUMNS:
        patterns, products = pattern_products(rows, k)

    def of_patterns(p: np.ndarray) -> np.ndarray:
        known, s = patterns.astype(float), products
        for q in done:
            left = known[:, :, None] * (np.eye(k) - (q[:, None] * q) / np.maximum(known @ q**2, TINY)[:, None, None])
            s = np.einsum("pij,pjk,plk->pil", left, s, left)
        size = np.maximum(known @ p**2, TINY)
        both = s @ p / size[:, None]
        squares = both @ p / size
        left = known[:, :, None] * (np.eye(k) - (p[:, None] * p) / size[:, None, None])
        return np.stack([both.sum(0), squares @ known, np.full(k, squares.sum() / k), np.einsum("pij,pjk,pik->i", left, s, left)])

    def sums(p: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((4, k))
            for b in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                known = ~np.isnan(x)
                x = deflated(x, known)
                t = (x @ p) / np.maximum(known @ p**2, TINY)
                out += np.stack([t @ x, (t**2) @ known, np.full(k, (t**2).sum() / k), ((np.where(known, x - np.outer(t, p), 0)) ** 2).sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(4), k)), pa.array(np.tile(np.arange(k), 4)), pa.array(out.ravel())], ["i", "j", "x"])

        if k <= PATTERN_COLUMNS:
            return of_patterns(p)
        total = np.zeros((4, k))
        for r in rows.mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
            total[r["i"], r["j"]] = r["x"]
        return total

    for _ in range(min(components, k)):
        p = np.sqrt(own / max(own.sum(), TINY)) + 1e-3
        p /= np.linalg.norm(p)
        for _ in range(most):
            s = sums(p)
            new = s[0] / np.maximum(s[1], TINY)
            new /= max(np.linalg.norm(new), TINY)
            moved = min(np.abs(new - p).max(), np.abs(new + p).max())
            p = new
            if moved < tolerance:
                break
        p = p * positive(p[:, None])[0]
        s = sums(p)
        scales.append(math.sqrt(s[2].sum() / max(n - 1, 1)))
        r2.append(1 - s[3].sum() / max(own.sum(), TINY))
        done.append(p)
    return PCA(columns, np.stack(done, 1), np.array(scales), n, np.array(r2), np.zeros((k, len(done))))


def fit_tsr(df: DataFrame, columns: Sequence[str], components: int, most: int = 100, tolerance: float = 1e-8) -> tuple[PCA, np.ndarray]:
    """PCA of the columns about their means with missing cells, by trimmed-score regression; and the means.

    Each pass fills a row's missing cells by their regression on the scores that
    its known cells give alone, and sums the moments of the filled rows; passes
    go on until the covariances no longer move.
    """
    columns = list(columns)
    k = len(columns)
    rows = written(df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna("all"))  # read by every pass
    first = rows.agg(*(f(c) for c in columns for f in (F.avg, F.var_pop))).first()
    mean, covariance = np.array([x or 0.0 for x in first[::2]]), np.diag([x or 0.0 for x in first[1::2]]).astype(float)
    n = 0

    def filled(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        known = ~np.isnan(x)
        z = np.where(known, x - mean, 0.0)
        patterns, which = np.unique(known, axis=0, return_inverse=True)
        for i, own in enumerate(patterns):  # rows that lack the same cells are filled at once
            if own.all() or not own.any():
                continue
            at = np.flatnonzero(which.ravel() == i)
            q = p[own]
            inner = np.linalg.pinv(q.T @ covariance[np.ix_(own, own)] @ q)
            z[np.ix_(at, np.flatnonzero(~own))] = z[np.ix_(at, np.flatnonzero(own))] @ q @ inner @ q.T @ covariance[np.ix_(own, ~own)]
        return z

    def passed(p: np.ndarray | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k + 1))
            for b in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                z = filled(x, p) if p is not None else np.where(np.isnan(x), 0.0, x - mean)
                z = np.column_stack([np.ones(len(z)), z])
                total += z.T @ z
            i, j = np.triu_indices(k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "x"])

        out = np.zeros((k + 1, k + 1))
        for r in rows.mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
            out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["x"]
        return out

    p = None
    for _ in range(most):
        total = passed(p)
        n = int(total[0, 0])
        shift = total[0, 1:] / max(n, 1)
        new = total[1:, 1:] / max(n, 1) - np.outer(shift, shift)
        moved = np.abs(new - covariance).max() / max(np.abs(new).max(), TINY)
        mean, covariance = mean + shift, new
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(values)[::-1][:components]
        p = vectors[:, order] * positive(vectors[:, order])
        if moved < tolerance:
            break
    values = np.maximum(values[order], 0)
    own = np.diag(covariance)
    explained = np.cumsum(p**2 * values, axis=1)
    return PCA(columns, p, np.sqrt(values * n / max(n - 1, 1)), n, np.cumsum(values) / max(own.sum(), TINY), np.divide(explained, own[:, None], out=np.zeros_like(explained), where=own[:, None] > 0)), mean


@dataclass
class PLS:
    """Projection to latent structures of several y, scaled by default, from cross products alone."""

    x: list[str]
    y: list[str]
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    loadings: np.ndarray
    y_loadings: np.ndarray
    rotation: np.ndarray
    score_scale: np.ndarray
    n: int
    r2x: np.ndarray
    r2y: np.ndarray
    spe_moments: tuple[float, float] = (0.0, 0.0)

    @classmethod
    def fit(cls, df: DataFrame, x: Sequence[str], y: Sequence[str], components: int, scale: bool = True, limits: bool = True) -> PLS:
        x, y = list(x), list(y)
        m = moments(df, [*x, *y])
        out = cls.of_products(m.n, m.sums, m.products, x, y, components, scale, m.pivot)
        if limits:
            row = out.diagnose(df.dropna(subset=[*x, *y])).agg(F.avg(F.col("spe") ** 2), F.var_samp(F.col("spe") ** 2)).first()
            out.spe_moments = (row[0] or 0.0, row[1] or 0.0)
        return out

    @classmethod
    def of_products(cls, n: int, sums: np.ndarray, products: np.ndarray, x: list[str], y: list[str], components: int, scale: bool = True, pivot: np.ndarray | float = 0.0) -> PLS:
        """From rows, sums and sums of products of x and y, less a pivot near their means."""
        k = len(x)
        covariance = products - np.outer(sums, sums) / max(n, 1)
        mean = pivot + sums / max(n, 1)
        sd = np.sqrt(np.maximum(np.diag(covariance), 0) / max(n - 1, 1))
        sd = np.where(sd > TINY, sd, 1.0) if scale else np.ones(len(mean))
        c = covariance / np.outer(sd, sd)
        xx, xy, yy = c[:k, :k].copy(), c[:k, k:].copy(), np.diag(c)[k:]
        total_x = np.trace(xx)
        w_, p_, q_, s_, r2x, r2y = [], [], [], [], [], []
        rotation = np.zeros((k, 0))
        for _ in range(min(components, k, max(n - 1, 1))):
            u, s, _ = np.linalg.svd(xy, full_matrices=False)
            if not s[0] > 1e-12:
                break
            w = u[:, 0]
            w = w * positive(w[:, None])[0]
            r = w.copy()
            for j in range(rotation.shape[1]):
                r -= (p_[j] @ w) * rotation[:, j]
            tt = float(r @ c[:k, :k] @ r)
            p, q = c[:k, :k] @ r / tt, c[:k, k:].T @ r / tt
            xy -= np.outer(p, q) * tt
            rotation = np.column_stack([rotation, r])
            w_.append(w)
            p_.append(p)
            q_.append(q)
            s_.append(math.sqrt(tt / max(n - 1, 1)))
            r2x.append(float(p @ p) * tt / total_x)
            r2y.append(float((q**2).sum() * tt / max(yy.sum(), TINY)))
        stack = lambda v, m: np.stack(v, 1) if v else np.zeros((m, 0))
        return cls(x, y, mean, sd, stack(w_, k), stack(p_, k), stack(q_, len(y)), rotation, np.array(s_), n, np.array(r2x), np.array(r2y))

    @property
    def components(self) -> int:
        return self.rotation.shape[1]

    @property
    def beta(self) -> np.ndarray:
        """Coefficients in the units of the data, one column for each y."""
        k = len(self.x)
        return (self.rotation @ self.y_loadings.T) * self.scale[k:] / self.scale[:k, None]

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        k = len(self.x)
        return (x - self.center[:k]) / self.scale[:k]

    def predict(self, df: DataFrame) -> DataFrame:
        k = len(self.x)
        return over_rows(df, self.x, [f"{c}_hat" for c in self.y], lambda x: (x - self.center[:k]) @ self.beta + self.center[k:])

    def transform(self, df: DataFrame) -> DataFrame:
        return over_rows(df, self.x, [f"t{a + 1}" for a in range(self.components)], lambda x: self._scaled(x) @ self.rotation)

    def diagnose(self, df: DataFrame) -> DataFrame:
        def run(x: np.ndarray) -> np.ndarray:
            x = self._scaled(x)
            t = x @ self.rotation
            k = len(self.x)
            return np.column_stack([t, ((t / self.score_scale) ** 2).sum(axis=1), np.sqrt(((x - t @ self.loadings.T) ** 2).sum(axis=1)), (t @ self.y_loadings.T) * self.scale[k:] + self.center[k:]])

        return over_rows(df, self.x, [*(f"t{a + 1}" for a in range(self.components)), "hotellings_t2", "spe", *(f"{c}_hat" for c in self.y)], run)

    def t2_limit(self, conflevel: float = 0.95) -> float:
        return t2_limit(self.n, self.components, conflevel)

    def spe_limit(self, conflevel: float = 0.95) -> float:
        return spe_limit_of(*self.spe_moments, conflevel)

    def names_out(self) -> list[str]:
        return [f"t{a + 1}" for a in range(self.components)]

    def score(self, df: DataFrame) -> dict[str, float]:
        """R2 of each y on df; one aggregate."""
        rows = self.predict(df.dropna(subset=[*self.x, *self.y]))
        row = rows.agg(*(f for c in self.y for f in (F.sum((F.col(c) - F.col(f"{c}_hat")) ** 2), F.var_pop(c) * F.count(c)))).first()
        return {c: 1 - row[2 * i] / row[2 * i + 1] if row[2 * i + 1] else math.nan for i, c in enumerate(self.y)}

    def detect_outliers(self, df: DataFrame, conflevel: float = 0.95, most: int | None = None) -> DataFrame:
        """Rows beyond a limit, or unusual among the others by extreme studentised deviates of T2 or SPE (see `flagged`)."""
        return flagged(self.diagnose(df), self.t2_limit(conflevel), self.spe_limit(conflevel), 1 - conflevel, most)

    def target_projection(self, df: DataFrame, response: int = 0) -> DataFrame:
        """The score of each row along the regression vector of one y, of unit length."""
        b = self.rotation @ self.y_loadings[response]
        b = b / np.linalg.norm(b)
        return over_rows(df, self.x, ["t_target"], lambda x: (self._scaled(x) @ b)[:, None])

    def vip(self) -> np.ndarray:
        """sqrt(K sum(r2 w^2) / sum(r2)) of each x."""
        return np.sqrt(len(self.x) * (self.weights**2 @ self.r2y) / self.r2y.sum())

    def selectivity_ratio(self, covariance: np.ndarray, response: int = 0) -> np.ndarray:
        """Explained over residual variation of each x along the target projection; covariance: of the scaled x."""
        b = self.rotation @ self.y_loadings[response]
        w = b / np.linalg.norm(b)
        p = covariance @ w / (w @ covariance @ w)
        explained = p**2 * (w @ covariance @ w)
        return explained / np.maximum(np.diag(covariance) - explained, TINY)

    def invert(self, targets: Sequence[float], along: Sequence[float] = ()) -> tuple[np.ndarray, np.ndarray]:
        """x for wanted y, and a basis of scores that change no y; `along` moves on that basis."""
        k = len(self.x)
        y = (np.asarray(targets, float) - self.center[k:]) / self.scale[k:]
        q = self.y_loadings
        t = np.linalg.pinv(q) @ y
        _, s, vt = np.linalg.svd(q)
        null = vt[(s > 1e-10).sum() :].T
        if len(along):
            t = t + null[:, : len(along)] @ np.asarray(along, float)
        return (t @ self.loadings.T) * self.scale[:k] + self.center[:k], null


def select_components(df: DataFrame, x: Sequence[str], y: Sequence[str], most: int, folds: int = 5, key: str | None = None) -> list[dict]:
    """Cross-validated error of each number of components: a fold's model is the whole cross product less the fold's own.

    One pass gives all folds' products, one scores all folds and sizes.
    """
    x, y = list(x), list(y)
    fold = F.pmod(F.xxhash64(key) if key else F.xxhash64(*x, *y), F.lit(folds)).cast("int")
    rows = df.select(*x, *y, fold.alias("_fold")).dropna()
    pivot, own = grouped_moments(rows, [*x, *y], folds, F.col("_fold"))
    whole = [sum(o[i] for o in own) for i in range(3)]
    models = [PLS.of_products(*(whole[i] - own[k][i] for i in range(3)), x, y, most, pivot=pivot) for k in range(folds)]
    k = len(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, count = np.zeros(most), 0
        for b in batches:
            data = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns])
            for f in range(folds):
                part = data[data[:, -1] == f]
                m = models[f]
                t = m._scaled(part[:, :k]) @ m.rotation
                for a in range(1, most + 1):
                    fit = (t[:, :a] @ m.y_loadings[:, :a].T) * m.scale[k:] + m.center[k:]
                    press[a - 1] += (((part[:, k:-1] - fit) / whole_scale) ** 2).sum()
            count += len(data)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, most + 1)), pa.array(press), pa.array(np.full(most, count))], ["a", "press", "n"])

    whole_scale = PLS.of_products(*whole, x, y, 1, pivot=pivot).scale[k:]
    found = rows.mapInArrow(run, "a long, press double, n long").groupBy("a").agg(F.sum("press").alias("press"), F.sum("n").alias("n")).orderBy("a").collect()
    return [{"components": r["a"], "rmsecv": math.sqrt(r["press"] / (r["n"] * len(y))), "q2": 1 - r["press"] / ((r["n"] - 1) * len(y))} for r in found]


@dataclass
class OPLS:
    """One predictive component of one y, after orthogonal ones have been taken off."""

    x: list[str]
    y: str
    center: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    orthogonal_weights: np.ndarray
    orthogonal_loadings: np.ndarray
    q: float

    @classmethod
    def fit(cls, df: DataFrame, x: Sequence[str], y: str, orthogonal: int = 1) -> OPLS:
        x = list(x)
        m = moments(df, [*x, y])
        n, k, mean, covariance = m.n, len(x), m.mean, m.centred
        sd = np.sqrt(np.diag(covariance) / (n - 1))
        sd = np.where(sd > TINY, sd, 1.0)
        c = covariance / np.outer(sd, sd)
        xx, xy = c[:k, :k].copy(), c[:k, k].copy()
        w = xy / np.linalg.norm(xy)
        w_o, p_o = [], []
        for _ in range(orthogonal):
            p = xx @ w / (w @ xx @ w)
            o = p - (w @ p) * w
            if np.linalg.norm(o) < 1e-10:
                break
            o /= np.linalg.norm(o)
            tt = o @ xx @ o
            q = xx @ o / tt
            step = np.eye(k) - np.outer(o, q)
            xx = step.T @ xx @ step
            w_o.append(o)
            p_o.append(q)
        tt = float(w @ xx @ w)
        stack = lambda v: np.stack(v, 1) if v else np.zeros((k, 0))
        return cls(x, y, mean, sd, w, stack(w_o), stack(p_o), float(w @ xy) / tt)

    def _corrected(self, x: np.ndarray) -> np.ndarray:
        k = len(self.x)
        x = (x - self.center[:k]) / self.scale[:k]
        for a in range(self.orthogonal_weights.shape[1]):
            x = x - np.outer(x @ self.orthogonal_weights[:, a], self.orthogonal_loadings[:, a])
        return x

    def correct(self, df: DataFrame) -> DataFrame:
        """df with its x less their orthogonal components, in the units of the data."""
        k = len(self.x)
        names = [f"{c}_corrected" for c in self.x]
        return over_rows(df, self.x, names, lambda x: self._corrected(x) * self.scale[:k] + self.center[:k])

    def invert(self, target: float) -> tuple[np.ndarray, np.ndarray]:
        """x for a wanted y along the predictive component, and the orthogonal loadings along which x may move without changing it."""
        k = len(self.x)
        t = (target - self.center[-1]) / self.scale[-1] / self.q
        return t * self.weight * self.scale[:k] + self.center[:k], self.orthogonal_loadings * self.scale[:k, None]

    def transform(self, df: DataFrame) -> DataFrame:
        """The predictive score and the prediction."""
        def run(x: np.ndarray) -> np.ndarray:
            t = self._corrected(x) @ self.weight
            return np.column_stack([t, t * self.q * self.scale[-1] + self.center[-1]])

        return over_rows(df, self.x, ["t_predictive", f"{self.y}_hat"], run)


def rv_coefficient(df: DataFrame, a: Sequence[str], b: Sequence[str]) -> float:
    """The RV coefficient of two centred blocks of columns."""
    c = moments(df, [*a, *b]).centred
    k = len(a)
    return float((c[:k, k:] ** 2).sum() / math.sqrt((c[:k, :k] ** 2).sum() * (c[k:, k:] ** 2).sum()))


@dataclass
class MultiBlock:
    """Consensus PCA or PLS of several blocks of columns: each scaled to unit variance and weighted by 1 / sqrt of its columns.

    The super scores of the hierarchical iteration are those of the weighted
    blocks side by side, so a fit is one pass of moments.  A block's weights are
    its part of a component's, at unit length; the lengths are the super weights.
    Block scores and residuals come from data less the earlier components.
    """

    blocks: dict[str, list[str]]
    y: list[str]
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    loadings: np.ndarray
    score_scale: np.ndarray
    n: int
    y_loadings: np.ndarray
    r2: np.ndarray
    spe_moments: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, blocks: dict[str, Sequence[str]], components: int, y: Sequence[str] = ()) -> MultiBlock:
        blocks, y = {k: list(v) for k, v in blocks.items()}, list(y)
        columns = [c for b in blocks.values() for c in b]
        m = moments(df, [*columns, *y])
        k, covariance = len(columns), m.centred
        sd = np.sqrt(np.diag(covariance) / (m.n - 1))
        sd = np.where(sd > TINY, sd, 1.0) * np.array([math.sqrt(len(b)) for b in blocks.values() for _ in b] + [1.0] * len(y))
        c = covariance / np.outer(sd, sd)
        if y:
            model = PLS.of_products(m.n, np.zeros(len(sd)), c, columns, y, components, scale=False)
            weights, loadings, scale, q = model.weights, model.loadings, model.score_scale, model.y_loadings
        else:
            values, vectors = np.linalg.eigh(c)
            order = np.argsort(values)[::-1][:components]
            weights = vectors[:, order] * positive(vectors[:, order])
            loadings, scale, q = weights, np.sqrt(np.maximum(values[order], 0) / (m.n - 1)), np.zeros((0, components))
        out = cls(blocks, y, m.mean, sd, weights, loadings, scale, m.n, q, np.zeros((0, 0)), {})
        rest, r2 = np.diag(c)[:k].copy(), []
        for a in range(out.components):
            rest = rest - loadings[:, a] ** 2 * scale[a] ** 2 * (m.n - 1)
            r2.append([1 - rest[i:j].sum() / max(np.diag(c)[i:j].sum(), TINY) for i, j in out.spans().values()])
        out.r2 = np.array(r2).T  # cumulative, a row a block
        spe = [f"{b}_spe" for b in blocks] + ["super_spe"]
        row = out.diagnose(df.dropna(subset=[*columns, *y])).agg(*(f(F.col(x) ** 2) for x in spe for f in (F.avg, F.var_samp))).first()
        out.spe_moments = {x: (row[2 * i] or 0.0, row[2 * i + 1] or 0.0) for i, x in enumerate(spe)}
        return out

    @property
    def components(self) -> int:
        return self.weights.shape[1]

    @property
    def columns(self) -> list[str]:
        return [c for b in self.blocks.values() for c in b]

    def spans(self) -> dict[str, tuple[int, int]]:
        at = np.cumsum([0, *(len(b) for b in self.blocks.values())]).tolist()
        return {b: (i, j) for b, i, j in zip(self.blocks, at, at[1:], strict=False)}

    def super_weights(self) -> np.ndarray:
        """A row a block: how much of each component's weight it has."""
        return np.array([np.linalg.norm(self.weights[i:j], axis=0) for i, j in self.spans().values()])

    def block_weights(self, block: str) -> np.ndarray:
        i, j = self.spans()[block]
        part = self.weights[i:j]
        return part / np.maximum(np.linalg.norm(part, axis=0), TINY)

    def vip(self, block: str) -> np.ndarray:
        """sqrt(K sum(r2 w^2) / sum(r2)) of each column of a block."""
        i, j = self.spans()[block]
        gain = np.diff(self.r2[list(self.blocks).index(block)], prepend=0)
        return np.sqrt((j - i) * (self.block_weights(block) ** 2 @ gain) / max(gain.sum(), TINY))

    def _steps(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each component the weighted data less the earlier ones, and the super score; at last what remains."""
        k = len(self.columns)
        z = (x - self.center[:k]) / self.scale[:k]
        for a in range(self.components):
            t = z @ self.weights[:, a]
            yield z, t
            z = z - np.outer(t, self.loadings[:, a])
        yield z, np.zeros(len(z))

    def diagnose(self, df: DataFrame) -> DataFrame:
        """Super scores, block scores, each block's and the merged squared prediction error's root, T2, and predictions of y."""
        spans, k = self.spans(), len(self.columns)
        wide = {b: math.sqrt(j - i) for b, (i, j) in spans.items()}

        def run(x: np.ndarray) -> np.ndarray:
            steps = list(self._steps(x))
            t = np.column_stack([s[1] for s in steps[:-1]])
            own = [steps[a][0][:, i:j] @ self.block_weights(b)[:, a] for b, (i, j) in spans.items() for a in range(self.components)]
            spe = [np.sqrt((steps[-1][0][:, i:j] ** 2).sum(axis=1)) * wide[b] for b, (i, j) in spans.items()]
            t2 = (np.divide(t, self.score_scale, out=np.zeros_like(t), where=self.score_scale > 0) ** 2).sum(axis=1)
            hat = (t @ self.y_loadings.T) * self.scale[k:] + self.center[k:] if self.y else np.zeros((len(x), 0))
            return np.column_stack([t, *own, *spe, np.sqrt(sum(s**2 for s in spe)), t2, hat])

        sizes = range(1, self.components + 1)
        names = [*(f"super_t{a}" for a in sizes), *(f"{b}_t{a}" for b in self.blocks for a in sizes), *(f"{b}_spe" for b in self.blocks), "super_spe", "hotellings_t2", *(f"{c}_hat" for c in self.y)]
        return over_rows(df, self.columns, names, run)

    def transform(self, df: DataFrame) -> DataFrame:
        """Super scores."""
        return over_rows(df, self.columns, [f"super_t{a + 1}" for a in range(self.components)], lambda x: np.column_stack([t for _, t in list(self._steps(x))[:-1]]))

    def t2_limit(self, conflevel: float = 0.95) -> float:
        return t2_limit(self.n, self.components, conflevel)

    def block_spe_limit(self, block: str, conflevel: float = 0.95) -> float:
        return spe_limit_of(*self.spe_moments[f"{block}_spe"], conflevel)

    def super_spe_limit(self, conflevel: float = 0.95) -> float:
        return spe_limit_of(*self.spe_moments["super_spe"], conflevel)

    def spe_contributions(self, df: DataFrame) -> DataFrame:
        """Squared residual of each column, in units of its variance."""
        wide = np.repeat([len(b) for b in self.blocks.values()], [len(b) for b in self.blocks.values()])
        return over_rows(df, self.columns, [f"{c}_spe" for c in self.columns], lambda x: list(self._steps(x))[-1][0] ** 2 * wide)

    def score_contributions(self, df: DataFrame, component: int = 1) -> DataFrame:
        """Each column's term of a super score."""
        return over_rows(df, self.columns, [f"{c}_t{component}" for c in self.columns], lambda x: list(self._steps(x))[component - 1][0] * self.weights[:, component - 1])

    def group_contributions(self, df: DataFrame, group: Column, component: int = 1) -> dict[str, float]:
        """Each column's term of the difference between the mean super score of a group and of the other rows."""
        rows = self.score_contributions(df, component)
        row = rows.agg(*(F.avg(F.when(group, F.col(f"{c}_t{component}"))) - F.avg(F.when(~group, F.col(f"{c}_t{component}"))) for c in self.columns)).first()
        return dict(zip(self.columns, (float(v or 0.0) for v in row), strict=True))


def parallel_analysis(model: PCA, simulations: int = 200, quantile: float = 0.95, seed: int = 0) -> int:
    """Components whose eigenvalues exceed those of noise of the same shape: covariances of n rows are drawn from their Wishart distribution, by Bartlett's factors."""
    r, k = np.random.default_rng(seed), len(model.columns)
    m = model.n - 1

    def covariance() -> np.ndarray:
        if m < k:  # fewer rows than the factors need: the rows themselves
            x = r.normal(size=(m, k))
            return x.T @ x / m
        factor = np.tril(r.normal(size=(k, k)), -1)
        factor[np.diag_indices(k)] = np.sqrt(r.chisquare(m - np.arange(k)))
        return factor @ factor.T / m

    noise = np.array([np.linalg.eigvalsh(covariance())[::-1][: model.components] for _ in range(simulations)])
    return int((model.score_scale**2 > np.quantile(noise, quantile, axis=0)).cumprod().sum())


def project_variables(model: PCA, df: DataFrame, extra: Sequence[str]) -> dict[str, list[float]]:
    """Correlations of other columns with the scores, in one aggregate."""
    scores = model.transform(df)
    names = [f"t{a + 1}" for a in range(model.components)]
    row = scores.agg(*(F.corr(c, t) for c in extra for t in names)).first()
    return {c: [row[i * len(names) + a] for a in range(len(names))] for i, c in enumerate(extra)}


def group_contributions(model: PCA, df: DataFrame, group: Column, component: int = 1) -> dict[str, float]:
    """(mean of the rows where `group` holds, less the mean of the others) times the loadings."""
    row = df.agg(*(F.avg(F.when(group, F.col(c))) - F.avg(F.when(~group, F.col(c))) for c in model.columns)).first()
    return {c: (v or 0.0) * float(p) for c, v, p in zip(model.columns, row, model.loadings[:, component - 1], strict=True)}


def observation_contributions(model: PCA, df: DataFrame) -> DataFrame:
    """Each row's share of each score's sum of squares."""
    whole = model.score_scale**2 * max(model.n - 1, 1)
    return over_rows(df, model.columns, [f"share_t{a + 1}" for a in range(model.components)], lambda x: np.divide((x @ model.loadings) ** 2, whole, out=np.zeros((len(x), model.components)), where=whole > 0))


def rv2_coefficient(rows: np.ndarray, a: Sequence[int], b: Sequence[int]) -> float:
    """RV of two blocks of a small matrix with the diagonals of their products left out."""
    x, y = (rows[:, list(i)] - rows[:, list(i)].mean(axis=0) for i in (a, b))
    p, q = x @ x.T, y @ y.T
    np.fill_diagonal(p, 0)
    np.fill_diagonal(q, 0)
    return float((p * q).sum() / math.sqrt((p**2).sum() * (q**2).sum()))


def prediction_interval(model: PLS, df: DataFrame, rmse: float, response: int = 0, conflevel: float = 0.95) -> DataFrame:
    """y_hat -/+ t s sqrt(1 + 1 / n + T2 / (n - 1))."""
    c = float(D.t_ppf(0.5 + conflevel / 2, model.n - model.components - 1)) * rmse
    half = c * F.sqrt(1 + 1 / model.n + F.col("hotellings_t2") / (model.n - 1))
    hat = F.col(f"{model.y[response]}_hat")
    return model.diagnose(df).withColumn("pi_low", hat - half).withColumn("pi_high", hat + half)


def select_rule(errors: Sequence[float], spreads: Sequence[float] | None = None, rule: str = "1se", gain: float = 0.01) -> int:
    """How many components: the least error, the fewest within one standard error of it, or the last that lowers the error by a share."""
    e = np.asarray(errors, float)
    best = int(e.argmin())
    if rule == "min":
        return best + 1
    if rule == "1se":
        s = float(np.asarray(spreads, float)[best]) if spreads is not None else 0.0
        return int(np.flatnonzero(e <= e[best] + s)[0]) + 1
    drop = np.diff(e) / -e[:-1]
    return int(np.flatnonzero(drop < gain)[0]) + 1 if (drop < gain).any() else len(e)


def minka_components(model: PCA) -> int:
    """How many components the Laplace evidence of probabilistic PCA favours (Minka, 2000); the model must have all of them."""
    k, n = len(model.columns), model.n
    values = np.maximum(model.score_scale**2, 1e-300)
    if len(values) < k:
        raise ValueError("fit all components first")
    best, chosen = -math.inf, 1
    for a in range(1, k):
        sphere = -a * math.log(2.0) + sum(math.lgamma((k - i) / 2) - (k - i) / 2 * math.log(math.pi) for i in range(a))
        noise = values[a:].mean()
        free = k * a - a * (a + 1) / 2
        full = np.append(values[:a], np.full(k - a, noise))
        curve = 0.0
        for i in range(a):
            own = (1 / full[i + 1 :] - 1 / full[i]) * (values[i] - values[i + 1 :])
            curve += np.log(np.maximum(own, 1e-300)).sum() + (k - i - 1) * math.log(n)
        evidence = sphere - n / 2 * np.log(values[:a]).sum() - n * (k - a) / 2 * math.log(noise) + (free + a) / 2 * math.log(2 * math.pi) - curve / 2 - a / 2 * math.log(n)
        if evidence > best:
            best, chosen = evidence, a
    return chosen


def nested_cv(df: DataFrame, x: Sequence[str], y: Sequence[str], most: int, outer: int = 5, inner: int = 4, key: str | None = None) -> list[dict]:
    """Of each outer fold: how many components the inner folds choose, and the error of that model on the outer fold.

    One pass makes the moments of all outer and inner folds together; every
    model is a sum of them.  One more pass judges the outer folds.
    """
    x, y = list(x), list(y)
    place = F.pmod(F.xxhash64(key) if key else F.xxhash64(*x, *y), F.lit(outer * inner)).cast("int")
    rows = df.select(*x, *y, place.alias("_place")).dropna()
    pivot, parts = grouped_moments(rows, [*x, *y], outer * inner, F.col("_place"))
    add = lambda chosen: [sum(parts[c][i] for c in chosen) for i in range(3)]
    cells = range(outer * inner)
    k, models = len(x), {}

    def error(model: PLS, own: list, a: int) -> float:
        """The squared error of a model on rows known by their moments about the pivot."""
        n, sums, products = own
        b = (model.rotation[:, :a] @ model.y_loadings[:, :a].T) * model.scale[k:] / model.scale[:k, None]
        move = model.center - pivot
        s = sums - n * move
        p = products - np.outer(sums, move) - np.outer(move, sums) + n * np.outer(move, move)
        return float(np.trace(p[k:, k:]) - 2 * np.trace(b.T @ p[:k, k:]) + np.trace(b.T @ p[:k, :k] @ b)) if n else 0.0 * float(s.sum())

    out = []
    for o in range(outer):
        train = [c for c in cells if c % outer != o]
        press = np.zeros(most)
        for i in range(inner):
            held = [c for c in train if c // outer == i]
            model = PLS.of_products(*add([c for c in train if c // outer != i]), x, y, most, pivot=pivot)
            press += [error(model, add(held), a) for a in range(1, most + 1)]
        chosen = select_rule(press.tolist(), rule="min")
        model = PLS.of_products(*add(train), x, y, chosen, pivot=pivot)
        own = add([c for c in cells if c % outer == o])
        out.append({"fold": o, "components": chosen, "rmsep": math.sqrt(max(error(model, own, chosen), 0.0) / max(own[0] * len(y), 1)), "n": int(own[0])})
        models[o] = model
    return out
