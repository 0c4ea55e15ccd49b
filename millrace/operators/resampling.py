"""Resampling of models from cross products: rows are dealt to groups once, and a resample is a sum of groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.linear import pilot


def grouped_moments(df: DataFrame, columns: Sequence[str], groups: int, group: Column, pivot: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """A pivot near the means, and count, sums and sums of products of the columns less it, of each of `groups` groups of rows, in one pass."""
    k = len(columns)
    pivot = pilot(df, columns) if pivot is None else pivot
    rows = df.select(group.alias("g"), *((F.col(c).cast("double") - float(v)).alias(f"c{i}") for i, (c, v) in enumerate(zip(columns, pivot, strict=True)))).dropna()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    out = [(0, np.zeros(k), np.zeros((k, k))) for _ in range(groups)]
    for r in rows.groupBy("g").agg(F.count(F.lit(1)), *(F.sum(f"c{i}") for i in range(k)), *(F.sum(F.col(f"c{i}") * F.col(f"c{j}")) for i, j in pairs)).collect():
        m = np.zeros((k, k))
        for (i, j), x in zip(pairs, r[k + 2 :], strict=True):
            m[i, j] = m[j, i] = x
        out[r[0]] = (r[1], np.array(r[2 : k + 2], float), m)
    return pivot, out


def grouped_products(df: DataFrame, columns: Sequence[str], groups: int, key: str, pivot: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products (of the columns less a pivot, if there is one) of each of `groups` groups of rows by a hash of the key."""
    return grouped_moments(df, columns, groups, F.pmod(F.xxhash64(key), F.lit(groups)), np.zeros(len(columns)) if pivot is None else pivot)[1]


def jackknife(groups: list, fit: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The whole fit, and standard errors from leaving each group out."""
    total = [sum(g[i] for g in groups) for i in range(3)]
    left = np.array([fit(*(total[i] - g[i] for i in range(3))) for g in groups])
    m = len(groups)
    return fit(*total), np.sqrt((m - 1) / m * ((left - left.mean(axis=0)) ** 2).sum(axis=0))


def bootstrap(groups: list, fit: Callable[[int, np.ndarray, np.ndarray], np.ndarray], times: int = 200, seed: int = 0, conflevel: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The whole fit and its percentile interval from groups drawn with replacement."""
    r, m = np.random.default_rng(seed), len(groups)
    fits = []
    for _ in range(times):
        own = [groups[i] for i in r.integers(0, m, m)]
        fits.append(fit(*(sum(g[i] for g in own) for i in range(3))))
    tail = (1 - conflevel) / 2
    return fit(*(sum(g[i] for g in groups) for i in range(3))), np.quantile(fits, tail, axis=0), np.quantile(fits, 1 - tail, axis=0)
