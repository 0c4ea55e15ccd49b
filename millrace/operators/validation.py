"""How many components: validation by cells, by randomised signs, and of overlapping subsets.

Folds, signs and subsets come from hashes of a row's key (and a cell's column, or
the number of a draw), so no row is copied and nothing is gathered: hundreds of
draws are columns of one matrix product in each task, and only their sums leave it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.latent import PLS
from millrace.operators.linear import pilot
from millrace.operators.resampling import grouped_moments
from millrace.sources.tables import written

U64 = np.uint64
EPS = math.sqrt(np.finfo(float).eps)


def spread(x: np.ndarray) -> np.ndarray:
    """64-bit values mixed: the finaliser of splitmix64."""
    x = x.astype(U64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    return x ^ x >> U64(31)


def bits(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """A fair bit of each key (rows) and draw (columns): 64 draws a hash."""
    words = np.arange(1, -(-draws // 64) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)
    mixed = spread(spread(keys.view(U64))[:, None] + spread(words))
    return np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(len(keys), -1), axis=1, bitorder="little")[:, :draws]


def signs(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    return bits(keys, draws, seed).astype(np.float64) * 2 - 1


def row_key(columns: Sequence[str], key: str | Sequence[str] | None) -> Column:
    """A hash that tells rows apart: of the key, or of all columns and the row's place in the plan."""
    if key is None:
        return F.xxhash64(*columns, F.monotonically_increasing_id())
    return F.xxhash64(*([key] if isinstance(key, str) else key))


def matrix_sums(rows: DataFrame, make: Callable[[list[np.ndarray]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over rows of make(columns of a batch), an array of the given shape; added in tasks, then by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += make([c.to_numpy(zero_copy_only=False) for c in b.columns])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    out = np.zeros(math.prod(shape))
    for r in rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(shape)


@dataclass
class CellPress:
    """press: squared error of held-out cells by number of components (from 1); by fold in per_fold, null for a fold without cells."""

    press: np.ndarray
    per_fold: np.ndarray
    passes: int

    def recommended(self) -> int:
        """The fewest components whose error is within one standard error of the least."""
        best = int(self.press.argmin())
        own = self.per_fold[best]
        error = np.nanstd(own, ddof=1) * math.sqrt((~np.isnan(own)).sum())
        return int(np.flatnonzero(self.press <= self.press[best] + error)[0]) + 1


#: Columns up to which cells known, held out and missing make few patterns (3 ** 6).
PATTERN_COLUMNS = 6


def _cell_moments(rows: DataFrame, dealt: Callable, center: np.ndarray, scale: np.ndarray, folds: int) -> np.ndarray:
    """For each fold and pattern (digits of base 3 by column: known, held out, missing) the sums of products of 1 and the fold's scaled cells, missing ones 0."""
    k = center.shape[1]
    powers = 3 ** np.arange(k)

    def make(columns: list[np.ndarray]) -> np.ndarray:
        x, fold = dealt(columns)
        missing = np.isnan(x)
        out = np.zeros((folds, 3**k, k + 1, k + 1))
        for f in range(folds):
            pattern = np.where(missing, 2, fold == f) @ powers
            z = np.column_stack([np.ones(len(x)), np.where(missing, 0.0, (x - center[f]) / scale[f])])
            order = np.argsort(pattern, kind="stable")
            found, at = np.unique(pattern[order], return_index=True)
            for p, own in zip(found, np.split(z[order], at[1:]), strict=True):
                out[f, p] = own.T @ own
        return out

    return matrix_sums(rows, make, (folds, 3**k, k + 1, k + 1))


def _settled(own: np.ndarray, k: int, components: int, center: np.ndarray, scale: np.ndarray, most: int, tolerance: float) -> float:
    """The squared error of a fold's held cells once their reconstructions settle; NaN without such cells."""
    seen = np.flatnonzero(own[:, 0, 0] > 0)
    state = seen[:, None] // 3 ** np.arange(k) % 3
    known, held = (state == 0).astype(float), (state == 1).astype(float)
    n, s, ss = own[seen, 0, 0], own[seen, 0, 1:], own[seen, 1:, 1:]
    if not (held.sum(1) @ n) > 0:
        return math.nan
    squares = lambda m: (held * np.einsum("pij,pjk,pik->pi", m, ss, m) * scale**2).sum()
    first = known[:, :, None] * np.eye(k)
    now = first
    for step in range(most):
        p = np.linalg.eigh(np.einsum("pij,pjk,plk->il", now, ss, now))[1][:, ::-1][:, :components]
        now, before = first + (1 - known)[:, :, None] * (p @ p.T @ now), now
        level = np.einsum("pij,pj->pi", before, s)
        was = squares(before) + (held * (2 * scale * center * level + n[:, None] * center**2)).sum()
        if math.sqrt(squares(now - before)) < tolerance * max(1.0, math.sqrt(max(was, 0.0))):
            break
    return float(squares(np.eye(k) - now))


def press_by_cells(df: DataFrame, columns: Sequence[str], components: int, folds: int = 5, key: str | Sequence[str] | None = None, most: int = 50, tolerance: float = 1e-6, seed: int = 0) -> CellPress:
    """Cross-validated error of PCA by cells (element-wise folds, Bro 2008).

    A cell's fold is a hash of its row and column.  Each fold is centred and
    scaled by its own other cells; its cells begin at their columns' means and
    are reconstructed again and again, at most `most` times or until they settle.
    A reconstruction is linear in a row's known cells, by a matrix that rows with
    the same cells known, held out and missing share: up to PATTERN_COLUMNS
    columns, one pass sums the moments of each such pattern and fold, and the
    reconstructions are products of small matrices.  With more columns, patterns
    may be as many as rows; then a pass is one reconstruction for all folds and
    all numbers of components at once: a row repeats the earlier ones from the
    loadings so far, which are all that is kept, and only K x K products leave
    the tasks.  Missing cells are filled too, and not judged.
    """
    columns = list(columns)
    k = len(columns)
    components = min(components, k)
    named = [F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = written(df.select(row_key(columns, key).alias("h"), *named).dropna("all", subset=[f"c{i}" for i in range(k)]))
    column_keys = spread(np.arange(1, k + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))

    def dealt(columns_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        fold = spread(columns_[0].view(U64)[:, None] ^ column_keys) % U64(folds)
        return np.column_stack(columns_[1:]), fold.astype(np.int64)

    at = pilot(rows, [f"c{i}" for i in range(k)])

    def first(columns_: list[np.ndarray]) -> np.ndarray:
        x, fold = dealt(columns_)
        out = np.zeros((3, folds, k))
        for f in range(folds):
            own = np.where((fold != f) & ~np.isnan(x), x - at, np.nan)
            out[:, f] = (~np.isnan(own)).sum(0), np.nansum(own, 0), np.nansum(own**2, 0)
        return out

    n, s, ss = matrix_sums(rows, first, (3, folds, k))
    mean = s / np.maximum(n, 1)
    sd = np.sqrt(np.maximum(ss - n * mean**2, 0) / np.maximum(n - 1, 1))
    center, scale = at + mean, np.where(sd > EPS, sd, 1.0)

    history: dict[tuple[int, int], list[np.ndarray]] = {(f, a): [] for f in range(folds) for a in range(components)}

    def make(columns_: list[np.ndarray], run: dict) -> np.ndarray:
        x, fold = dealt(columns_)
        out = np.zeros((len(run), k * k + 4))
        for i, ((f, _), steps) in enumerate(run.items()):
            held, known = (fold == f) & ~np.isnan(x), (fold != f) & ~np.isnan(x)
            z = before = np.where(known, (x - center[f]) / scale[f], 0.0)
            for p in steps:
                z, before = np.where(known, z, z @ p @ p.T), z
            moved, was = (z - before) * scale[f], before * scale[f] + center[f]
            error = np.nan_to_num(x) - z * scale[f] - center[f]
            out[i] = [*(z.T @ z).ravel(), *((v[held] ** 2).sum() for v in (error, moved, was)), held.sum()]
        return out

    per_fold = np.full((components, folds), np.nan)
    if k <= PATTERN_COLUMNS:
        for f, own in enumerate(_cell_moments(rows, dealt, center, scale, folds)):
            for a in range(components):
                per_fold[a, f] = _settled(own, k, a + 1, center[f], scale[f], most, tolerance)
        return CellPress(np.nansum(per_fold, axis=1), per_fold, 2)
    waiting, passes = dict(history), 0
    while waiting:
        run = {key: list(steps) for key, steps in waiting.items()}
        total = matrix_sums(rows, lambda c, run=run: make(c, run), (len(run), k * k + 4))
        passes += 1
        for (f, a), own in zip(run, total, strict=True):
            error, moved, was, cells = own[k * k :]
            steps = waiting[f, a]
            if not cells or steps and (len(steps) >= most or math.sqrt(moved) < tolerance * max(1.0, math.sqrt(was))):
                per_fold[a, f] = error if cells else np.nan
                del waiting[f, a]
            else:
                steps.append(np.linalg.eigh(own[: k * k].reshape(k, k))[1][:, ::-1][:, : a + 1])
    return CellPress(np.nansum(per_fold, axis=1), per_fold, passes)


@dataclass
class Comparison:
    """For each number of components (from 1): rmsecv, the excess of its squared errors over those of the best, and the p value of that excess."""

    rmsecv: list[float]
    excess: list[float]
    p_values: list[float]
    recommended: int


def compare_components(df: DataFrame, x: Sequence[str], y: Sequence[str], most: int, folds: int = 5, key: str | Sequence[str] | None = None, fold: Column | None = None, draws: int = 999, alpha: float = 0.01, seed: int = 0) -> Comparison:
    """Are fewer components as good?  Randomised signs of paired out-of-fold squared errors (van der Voet, 1994).

    Models of all folds come from one pass of moments.  A second pass sums every
    row's squared errors, of each number of components, times the signs of all
    draws; differences to the best model are differences of those sums.
    """
    x, y = list(x), list(y)
    k = len(x)
    h = row_key([*x, *y], key)
    rows = written(df.select(h.alias("h"), (F.pmod(h, F.lit(folds)) if fold is None else fold).cast("int").alias("f"), *(F.col(c).cast("double").alias(c) for c in [*x, *y])).dropna())
    pivot, own = grouped_moments(rows, [*x, *y], folds, F.col("f"))
    whole = [sum(o[i] for o in own) for i in range(3)]
    models = [PLS.of_products(*(whole[i] - own[f][i] for i in range(3)), x, y, most, pivot=pivot) for f in range(folds)]
    sizes = min(m.components for m in models)
    scale = PLS.of_products(*whole, x, y, 1, pivot=pivot).scale[k:]

    def make(columns: list[np.ndarray]) -> np.ndarray:
        data = np.column_stack(columns[2:])
        error = np.zeros((sizes, len(data)))
        for f, m in enumerate(models):
            mine = columns[1] == f
            t = m._scaled(data[mine, :k]) @ m.rotation
            for a in range(sizes):
                fit = (t[:, : a + 1] @ m.y_loadings[:, : a + 1].T) * m.scale[k:] + m.center[k:]
                error[a, mine] = (((data[mine, k:] - fit) / scale) ** 2).sum(1)
        return np.column_stack([error.sum(1), error @ signs(columns[0], draws, seed)])

    total = matrix_sums(rows, make, (sizes, draws + 1))
    best = int(total[:, 0].argmin())
    excess = total - total[best]
    p = [1.0 if a == best else float((np.sum(excess[a, 1:] >= excess[a, 0]) + 1) / (draws + 1)) for a in range(sizes)]
    recommended = next((a + 1 for a in range(sizes) if p[a] > alpha), best + 1)
    rmsecv = np.sqrt(total[:, 0] / max(whole[0] * len(y), 1))
    return Comparison(rmsecv.tolist(), excess[:, 0].tolist(), p, recommended)


def component_risk(df: DataFrame, x: Sequence[str], y: str, components: int, key: str | Sequence[str] | None = None, draws: int = 999, seed: int = 0) -> list[dict]:
    """Of each PLS component: its correlation with what earlier ones leave of y, and the share of random signs of the rows whose own is as large.

    One pass after the fit; no row is copied or moved.
    """
    x = list(x)
    model = PLS.fit(df, x, [y], components, limits=False)
    rows = df.select(row_key([*x, y], key).alias("h"), *(F.col(c).cast("double").alias(c) for c in [*x, y])).dropna()
    center, scale, k = float(model.center[-1]), float(model.scale[-1]), model.components

    def make(columns: list[np.ndarray]) -> np.ndarray:
        t = model._scaled(np.column_stack(columns[1:-1])) @ model.rotation
        steps = np.column_stack([np.zeros(len(t)), np.cumsum(t * model.y_loadings[0], axis=1)[:, :-1]])
        u = ((columns[-1] - center) / scale)[:, None] - steps
        both = t * u
        return np.column_stack([(t**2).sum(0), (u**2).sum(0), both.sum(0), both.T @ signs(columns[0], draws, seed)])

    total = matrix_sums(rows, make, (k, draws + 3))
    statistic = np.abs(total[:, 2:]) / np.sqrt(np.maximum(total[:, :1] * total[:, 1:2], 1e-300))
    return [{"component": a + 1, "statistic": float(statistic[a, 0]), "risk": float((np.sum(statistic[a, 1:] >= statistic[a, 0]) + 1) / (draws + 1))} for a in range(k)]


def fractional(df: DataFrame, columns: Sequence[str], fit: Callable[[int, np.ndarray, np.ndarray], np.ndarray], fraction: float = 0.8, repeats: int = 100, key: str | Sequence[str] | None = None, conflevel: float = 0.95, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A fit of the moments (rows, sums, products) of all rows; and the mean, and ends of the percentile interval, of fits of repeated random fractions of them.

    Subsets overlap: a row is in subset b if its hash with b lies below the
    fraction.  One pass sums the moments of all subsets: rows' products times
    their marks.
    """
    if not 0 < fraction <= 1 or repeats < 1:
        raise ValueError("a fraction lies within (0, 1], and there is one repeat at least")
    columns = list(columns)
    k, at = len(columns), pilot(df, columns)
    rows = df.select(row_key(columns, key).alias("h"), *(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    draws = np.arange(1, repeats + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)
    i, j = np.triu_indices(k + 1)

    def make(data: list[np.ndarray]) -> np.ndarray:
        z = np.column_stack([np.ones(len(data[0])), np.column_stack(data[1:]) - at])
        chosen = (spread(spread(data[0].view(U64))[:, None] + spread(draws)) >> U64(11)).astype(float) < fraction * 2.0**53
        return np.column_stack([np.ones(len(z)), chosen]).T @ (z[:, i] * z[:, j])

    total = matrix_sums(rows, make, (repeats + 1, len(i)))

    def fitted(row: np.ndarray) -> np.ndarray:
        m = np.zeros((k + 1, k + 1))
        m[i, j] = m[j, i] = row
        n, s = m[0, 0], m[0, 1:]
        cross = np.outer(s, at)
        return np.asarray(fit(int(round(n)), s + n * at, m[1:, 1:] + cross + cross.T + n * np.outer(at, at)))

    whole = fitted(total[0])
    fits = np.array([fitted(r) for r in total[1:] if r[0] > 0])
    tail = (1 - conflevel) / 2
    return whole, fits.mean(0), np.quantile(fits, tail, axis=0), np.quantile(fits, 1 - tail, axis=0)
