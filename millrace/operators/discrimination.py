"""Which descriptors of products tell their attributes: out-of-sample gates, permuted nulls, knock-off columns, and designed factors.

Products are rows, descriptors and attributes few columns.  Models come from
moments.  A model without one product is the moments less that row's own, so
leave-one-out is a map over the rows.  Permutations happen within blocks of at
most BLOCK rows that a hash has dealt (one block, and so any order, for up to
that many products): rows travel once, and hundreds of permutations are columns
of one product of matrices in each task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import distributions as D
from millrace.operators.latent import PLS
from millrace.operators.linear import Moments, moments
from millrace.operators.univariate import benjamini_hochberg
from millrace.operators.validation import matrix_sums, row_key
from millrace.sources.tables import written

#: Rows within which values are permuted, on average.
BLOCK = 4096


def clusters(correlation: np.ndarray, threshold: float) -> list[int]:
    """The connected component of each column, if columns of at least that absolute correlation are linked; numbered in the order of columns."""
    linked = np.nan_to_num(np.abs(correlation)) >= threshold
    np.fill_diagonal(linked, True)
    least = np.arange(len(linked))
    while True:
        new = np.where(linked, least[None, :], len(linked)).min(axis=1) if len(linked) else least
        if (new == least).all():
            break
        least = new
    return np.unique(least, return_inverse=True)[1].tolist()


def block_sums(rows: DataFrame, key: str, make: Callable[[np.ndarray, np.random.Generator], np.ndarray], shape: tuple[int, ...], seed: int) -> np.ndarray:
    """The sum over blocks of make(the block's other columns, random numbers of its own).

    Blocks are dealt by the key's hash and ordered by it, so the same table gives the same sum however it is partitioned.
    """
    names = [c for c in rows.columns if c != key]
    parts = max(1, -(-rows.count() // BLOCK))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(parts)))

    def one(number: tuple, f: pd.DataFrame) -> pd.DataFrame:
        own = f.sort_values([key, *names])[names].to_numpy(float)
        total = make(own, np.random.default_rng([seed, int(number[0])]))
        return pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    out = np.zeros(math.prod(shape))
    for r in dealt.groupBy("_block").applyInPandas(one, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(shape)


def shuffled(n: int, times: int, random: np.random.Generator) -> np.ndarray:
    """`times` independent orders of n rows, as columns."""
    return random.permuted(np.tile(np.arange(n)[:, None], (1, times)), axis=0)


def left_out(rows: DataFrame, m: Moments, x: list[str], y: str, components: int) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Squared error of each row by the model of all others; mean and jackknife error of those models' scaled coefficients."""
    k = len(x)

    def make(columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((3, k + 1))
        for z in np.column_stack(columns) - m.pivot:
            model = PLS.of_products(m.n - 1, m.sums - z, m.products - np.outer(z, z), x, [y], components, pivot=m.pivot)
            raw = z + m.pivot
            b = (model.rotation @ model.y_loadings.T)[:, 0]
            fit = (raw[:k] - model.center[:k]) / model.scale[:k] @ b * model.scale[k] + model.center[k]
            out[0, 0] += (raw[k] - fit) ** 2
            out[1, :k] += b
            out[2, :k] += b * b
            out[0, k] += 1
        return out

    total = matrix_sums(rows.select(*x, y), make, (3, k + 1))
    n = int(total[0, k])
    mean = total[1, :k] / max(n, 1)
    spread = np.sqrt(np.maximum(total[2, :k] - n * mean**2, 0) * max(n - 1, 0) / max(n, 1))
    return total[0, 0], mean, spread, n


def selectivity(m: Moments, x: list[str], y: str, components: int, xy: np.ndarray | None = None) -> np.ndarray | None:
    """The selectivity ratio of each descriptor, of the moments or of the same with other products of x and y."""
    k = len(x)
    products = m.products
    if xy is not None:
        products = products.copy()
        products[:k, k] = products[k, :k] = xy
    model = PLS.of_products(m.n, m.sums, products, x, [y], components, pivot=m.pivot)
    if not model.components or not model.y_loadings.any():
        return None
    c = m.centred[:k, :k] / max(m.n - 1, 1) / np.outer(model.scale[:k], model.scale[:k])
    return model.selectivity_ratio(c)


def discriminate(products: DataFrame, attributes: Sequence[str], descriptors: Sequence[str], key: str, components: int = 2, alpha: float = 0.05, permutations: int = 199, threshold: float = 0.95, most_components: int = 4, seed: int = 0) -> tuple[list[dict], list[dict]]:
    """Of each attribute, whether descriptors tell it out of sample; of each descriptor, whether it is among those that do.

    A descriptor counts if its selectivity ratio exceeds the largest of all
    descriptors in all but a share alpha of permutations, the attribute is
    predictable at all (Q2 > 0, products left out one by one), and its
    coefficient stays away from zero whichever product is left out.  Descriptors
    of one cluster cannot be told apart.
    """
    x, out, told = list(descriptors), [], []
    k = len(x)
    whole = moments(products, x).centred
    sd = np.sqrt(np.maximum(np.diag(whole), 1e-300))
    cluster = clusters(whole / np.outer(sd, sd), threshold)
    for attribute in attributes:
        rows = written(products.select(F.col(key).alias("_key"), *(F.col(c).cast("double").alias(c) for c in (*x, attribute))).dropna())
        m = moments(rows, [*x, attribute])
        a = max(1, min(components, most_components, k, m.n - 2))
        ratio = selectivity(m, x, attribute, a) if m.n > 2 else None
        q2 = rmsep = math.nan
        robust = np.zeros(k, bool)
        spread_y = float(m.centred[k, k])
        if ratio is not None and m.n >= 5 and spread_y > 0:
            press, _, error, n = left_out(rows, m, x, attribute, a)
            q2, rmsep = 1 - press / spread_y, math.sqrt(press / n)
            model = PLS.of_products(m.n, m.sums, m.products, x, [attribute], a, pivot=m.pivot)
            robust = np.abs((model.rotation @ model.y_loadings.T)[:, 0]) > D.t_ppf(1 - alpha / 2, n - 1) * error
        predictable = bool(q2 > 0)
        out.append({"attribute": attribute, "components": a if ratio is not None else 0, "q2_cv": float(q2), "rmsep_cv": float(rmsep), "predictable": predictable})
        each, largest = np.ones(k), np.ones(k)
        if predictable:
            pivot = m.pivot

            def make(z: np.ndarray, random: np.random.Generator, pivot: np.ndarray = pivot) -> np.ndarray:
                z = z - pivot
                return z[:, :k].T @ z[:, k][shuffled(len(z), permutations, random)]

            xy = block_sums(rows, "_key", make, (k, permutations), seed)
            null = [r for r in (selectivity(m, x, attribute, a, xy[:, b]) for b in range(permutations)) if r is not None]
            each = (sum(r >= ratio for r in null) + 1) / (len(null) + 1)
            largest = (sum(np.nanmax(r) >= ratio for r in null) + 1) / (len(null) + 1)
        for i, d in enumerate(x):
            told.append({"attribute": attribute, "descriptor": d, "selectivity_ratio": float(ratio[i]) if ratio is not None else 0.0, "p_value": float(each[i]), "q_value": float(largest[i]), "jackknife_significant": bool(robust[i]), "discriminator_significant": bool(largest[i] <= alpha and predictable and robust[i]), "cluster_id": cluster[i]})
    return out, told


def knock_offs(products: DataFrame, attributes: Sequence[str], descriptors: Sequence[str], key: str, ignore: Sequence[str] = (), components: int = 2, fraction: float = 0.15, least: int = 7, most: int | None = None, times: int = 200, quantile: float = 0.95, folds: int = 8, seed: int = 0) -> list[dict]:
    """Importance and cross-validated coefficient of each descriptor, against those that permuted copies of descriptors reach by chance.

    Each time, some columns are copied with their rows shuffled and stand beside
    the real ones in a model of all attributes.  The coefficient is the mean over
    models that leave out one of `folds` groups of rows.  One pass over the
    blocks sums the moments of all times and folds.
    """
    if not fraction > 0 or not 0 < quantile < 1 or least < 1 or times < 1:
        raise ValueError("fraction > 0, 0 < quantile < 1, least >= 1 and times >= 1 are asked for")
    unknown = sorted(set(ignore) - set(descriptors))
    if unknown:
        raise ValueError(f"unknown descriptors {unknown}")
    x, y = [c for c in descriptors if c not in set(ignore)], list(attributes)
    p, q = len(x), len(y)
    if p < 2:
        raise ValueError(f"two descriptors at least are asked for, there are {p}")
    k = max(least, round(fraction * p))
    k = k if most is None else min(k, most)
    rows = written(products.select(F.col(key).alias("_key"), *(F.col(c).cast("double").alias(c) for c in (*x, *y))).dropna())
    m = moments(rows, [*x, *y])
    source = np.random.default_rng(seed).integers(0, p, (times, k))
    size = 1 + p + k + q

    def make(z: np.ndarray, random: np.random.Generator) -> np.ndarray:
        z = z - m.pivot
        fold = random.integers(0, folds, len(z))
        out = np.zeros((times, folds, size, size))
        for b in range(times):
            null = np.take_along_axis(z[:, source[b]], shuffled(len(z), k, random), axis=0)
            full = np.column_stack([np.ones(len(z)), z[:, :p], null, z[:, p:]])
            for f in range(folds):
                own = full[fold == f]
                out[b, f] = own.T @ own
        return out

    total = block_sums(rows, "_key", make, (times, folds, size, size), seed)
    names = [*x, *(f"_null{j}" for j in range(k))]

    def model(t: np.ndarray) -> PLS:
        return PLS.of_products(int(round(t[0, 0])), t[0, 1:], t[1:, 1:], names, y, max(1, min(components, p, m.n - 1)))

    importance, coefficient = np.zeros((times, p + k)), np.zeros((times, p + k))
    for b in range(times):
        whole = total[b].sum(0)
        importance[b] = model(whole).vip()
        left = [model(whole - t) for t in total[b] if 0 < t[0, 0] < whole[0, 0] - 1]
        beta = np.mean([s.rotation @ s.y_loadings.T for s in left], axis=0)
        coefficient[b] = np.abs(beta).max(axis=1)
    vip_null, beta_null = (float(np.nanquantile(v[:, p:], quantile)) for v in (importance, coefficient))
    vip, beta = importance[:, :p].mean(0), coefficient[:, :p].mean(0)
    out = [{"descriptor": c, "vip": float(vip[i]), "vip_null_threshold": vip_null, "vip_exceeds_null": bool(vip[i] > vip_null), "cv_beta": float(beta[i]), "cv_beta_null_threshold": beta_null, "cv_beta_exceeds_null": bool(beta[i] > beta_null)} for i, c in enumerate(x)]
    return sorted(out, key=lambda r: -r["vip"])


def relate_designed(runs: DataFrame, attributes: Sequence[str], factors: Sequence[str], model: str = "main_effects", alpha: float = 0.05) -> DataFrame:
    """Each designed factor's effect on each attribute: estimate, standard error, t, p value, and the same adjusted over the whole family (Benjamini, Hochberg).

    model: main_effects, or interactions of pairs besides.  All attributes share
    one information matrix, which is inverted once; runs without one of the
    values are left out.  Effects that the runs cannot tell apart have no row.
    """
    if model not in ("main_effects", "interactions"):
        raise ValueError(f"unknown model {model!r}")
    terms = {c: F.col(c).cast("double") for c in factors}
    if model == "interactions":
        terms |= {f"{a}:{b}": F.col(a).cast("double") * F.col(b).cast("double") for i, a in enumerate(factors) for b in factors[i + 1 :]}
    names, y = [f"_t{i}" for i in range(len(terms))], list(attributes)
    m = moments(runs.select(*(v.alias(n) for n, v in zip(names, terms.values(), strict=True)), *y), [*names, *y])
    k, c = len(names), m.centred
    scale = np.sqrt(np.maximum(np.diag(c)[:k], 1e-300))
    value, vector = np.linalg.eigh(c[:k, :k] / np.outer(scale, scale))
    kept = value > 1e-9
    inverse = (vector[:, kept] / value[kept]) @ vector[:, kept].T / np.outer(scale, scale)
    # a term is told apart if it has no part in the directions without variation
    clear = (vector[:, ~kept] ** 2).sum(1) < 1e-9
    beta, df = inverse @ c[:k, k:], m.n - 1 - int(kept.sum())
    rows = []
    for j, attribute in enumerate(y):
        left = float(c[k + j, k + j] - beta[:, j] @ c[:k, k + j])
        for i, term in enumerate(terms):
            if clear[i] and df > 0:
                error = math.sqrt(max(left, 0.0) / df * inverse[i, i])
                t = float(beta[i, j]) / error if error > 0 else math.inf
                rows.append((attribute, term, float(beta[i, j]), error, t, float(D.t_two_sided(abs(t), df))))
    table = runs.sparkSession.createDataFrame(rows, "attribute string, term string, effect double, standard_error double, t double, p_value double")
    return benjamini_hochberg(table, "p_value").withColumn("significant", F.col("p_bh") <= alpha)
