"""Distribution functions in numpy, usable on the driver and in tasks."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    if p <= 0 or p >= 1:
        return -math.inf if p <= 0 else math.inf
    return _NORMAL.inv_cdf(p)


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or 1e-300)
            c = (1 + top / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def gamma_inc(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * h


def _invert(cdf, p: float, low: float, high: float) -> float:
    """The x with cdf(x) = p, by bisection after the upper end has been moved out."""
    if not 0 <= p <= 1 or math.isnan(p):
        return math.nan
    while cdf(high) < p:
        low, high = high, high * 2
        if high > 1e18:
            return math.inf
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def t_cdf(x: float, v: float) -> float:
    if math.isinf(v):
        return norm_cdf(x)
    tail = beta_inc(v / 2, 0.5, v / (v + x * x)) / 2
    return 1 - tail if x > 0 else tail


@lru_cache(4096)
def t_ppf(p: float, v: float) -> float:
    if p < 0.5:
        return -t_ppf(1 - p, v)
    return 0.0 if p == 0.5 else _invert(lambda x: t_cdf(x, v), p, 0.0, 2.0)


def t_two_sided(t: float, v: float) -> float:
    """The p value of a two-sided t test."""
    return beta_inc(v / 2, 0.5, v / (v + t * t)) if math.isfinite(t) else 0.0


def f_cdf(x: float, a: float, b: float) -> float:
    return beta_inc(a / 2, b / 2, a * x / (a * x + b)) if x > 0 else 0.0


def f_tail(x: float, a: float, b: float) -> float:
    return beta_inc(b / 2, a / 2, b / (a * x + b)) if x > 0 else 1.0


@lru_cache(4096)
def f_ppf(p: float, a: float, b: float) -> float:
    return _invert(lambda x: f_cdf(x, a, b), p, 0.0, 2.0)


def chi2_cdf(x: float, v: float) -> float:
    return gamma_inc(v / 2, x / 2)


@lru_cache(4096)
def chi2_ppf(p: float, v: float) -> float:
    return _invert(lambda x: chi2_cdf(x, v), p, 0.0, 2.0)


def noncentral_f_cdf(x: float, a: float, b: float, nc: float) -> float:
    """A Poisson mixture of beta functions, summed outwards from its largest term."""
    if x <= 0:
        return 0.0
    y, half, total = a * x / (a * x + b), nc / 2, 0.0
    weight = lambda j: math.exp(-half + (j * math.log(half) if half > 0 else (0.0 if j == 0 else -math.inf)) - math.lgamma(j + 1))
    mode = int(half)
    for steps in (range(mode, -1, -1), range(mode + 1, mode + 10_000)):
        for j in steps:
            w = weight(j)
            total += w * beta_inc(a / 2 + j, b / 2, y)
            if w < 1e-16:
                break
    return min(total, 1.0)


@lru_cache(8)
def _legendre(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function of an array."""
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-x / math.sqrt(2))


@lru_cache(64)
def _range_cdf_nodes(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distribution of the range of k normals on a grid of w, to be interpolated."""
    w = np.linspace(0, 12, 601)
    x, g = _legendre(96)
    z = 8 * x
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    inner = _phi(z[None, :]) - _phi(z[None, :] - w[:, None])
    return w, np.clip(k * 8 * (g * density * inner ** (k - 1)).sum(axis=1), 0, 1)


def studentized_range_cdf(q: float, k: int, v: float) -> float:
    """The range of k normals over an independent chi estimate with v degrees of freedom."""
    if q <= 0:
        return 0.0
    w, cdf = _range_cdf_nodes(k)
    if math.isinf(v):
        return float(np.interp(q, w, cdf))
    x, g = _legendre(128)
    spread = 8 / math.sqrt(2 * v)
    low, high = max(1e-9, 1 - spread), 1 + spread + 4 / v
    s = (high - low) / 2 * x + (high + low) / 2
    log_density = v / 2 * math.log(v) - math.lgamma(v / 2) - (v / 2 - 1) * math.log(2) + (v - 1) * np.log(s) - v * s * s / 2
    return float(min(1.0, (high - low) / 2 * (g * np.exp(log_density) * np.interp(q * s, w, cdf, right=1.0)).sum()))


def studentized_range_ppf(p: float, k: int, v: float) -> float:
    return _invert(lambda q: studentized_range_cdf(q, k, v), p, 0.0, 4.0)


def dunnett_cdf(t: float, k: int, v: float, rho: float = 0.5) -> float:
    """The largest of k absolute t statistics with equal correlations."""
    if t <= 0:
        return 0.0
    x, g = _legendre(64)
    z = 8 * x
    weight = 8 * g * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    spread = 8 / math.sqrt(2 * v)
    low, high = max(1e-9, 1 - spread), 1 + spread + 4 / v
    s = (high - low) / 2 * x + (high + low) / 2
    density = np.exp(v / 2 * math.log(v) - math.lgamma(v / 2) - (v / 2 - 1) * math.log(2) + (v - 1) * np.log(s) - v * s * s / 2)
    a, b = math.sqrt(rho), math.sqrt(1 - rho)
    inner = _phi((t * s[:, None] + a * z[None, :]) / b) - _phi((-t * s[:, None] + a * z[None, :]) / b)
    return float(min(1.0, (high - low) / 2 * (g * density * (weight * inner**k).sum(axis=1)).sum()))


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """Royston's approximation of the Shapiro-Wilk statistic and its p value."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return (1.0, 1.0) if n >= 3 else (math.nan, math.nan)
    m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    total, u = (m * m).sum(), 1 / math.sqrt(n)
    # fixed values: Royston's polynomials
    c_last = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157)
    c_next = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)
    a = m / math.sqrt(total)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        last = np.polyval([*c_last, 0.0], u) + a[-1]
        if n > 5:
            second = np.polyval([*c_next, 0.0], u) + a[-2]
            phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[[1, -2]] = -second, second
        else:
            a = m / math.sqrt((total - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[[0, -1]] = -last, last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if n <= 11:
        g = -2.273 + 0.459 * n
        mu, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        return w, 1 - norm_cdf((-math.log(g - math.log1p(-w)) - mu) / sd) if w < 1 else 1.0
    log = math.log(n)
    mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log))
    return w, 1 - norm_cdf((math.log1p(-w) - mu) / sd) if w < 1 else 1.0


def kolmogorov_tail(d: float, n: int) -> float:
    """The asymptotic p value of a Kolmogorov-Smirnov distance, with Stephens' correction."""
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
