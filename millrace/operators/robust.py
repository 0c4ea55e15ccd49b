"""Robust lines and locations, as functions of arrays."""

from __future__ import annotations

import math

import numpy as np

#: Cells of a matrix that are in memory at once.
CELLS = 1 << 20
#: Points up to which all pairs are taken; beyond, only those of points near the median.
ALL_PAIRS = 2048
#: Points whose own medians bound the median of all.
SAMPLE = 256


def _inner_medians(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The median of the slopes between each point `at` and all others; NaN if all have its x."""
    out, rows = np.full(len(at), np.nan), max(1, CELLS // max(len(x), 1))
    for k in range(0, len(at), rows):
        own = at[k : k + rows]
        dx, dy = x[None, :] - x[own, None], y[None, :] - y[own, None]
        slopes = np.divide(dy, dx, out=np.full(dx.shape, np.nan), where=dx != 0)
        keep = ~np.isnan(slopes).all(axis=1)
        out[k : k + rows][keep] = np.nanmedian(slopes[keep], axis=1)
    return out


def _surely(place: np.ndarray, x: np.ndarray, y: np.ndarray, theta: float, below: bool) -> np.ndarray:
    """For each point, how many of its slopes are below (or above) theta by more than rounding.

    place: the number of its x among the distinct ones, from 0.  With r = y -
    theta x, these are points further right whose r is lower, and further left
    whose r is higher (or the reverse): counted by halves, quarters and so on
    of the x.
    """
    if not math.isfinite(theta):
        return np.zeros(len(x), np.int64)
    r, n = y - theta * x, len(x)
    slack = 32 * np.finfo(float).eps * (np.abs(y).max() + abs(theta) * np.abs(x).max())
    ordered = np.argsort(r, kind="stable")
    rank = np.empty(n, np.int64)
    rank[ordered] = np.arange(n)
    lower, upto = np.searchsorted(r[ordered], r - slack, "left"), np.searchsorted(r[ordered], r + slack, "right")
    out = np.zeros(n, np.int64)
    for bit in range(int(place.max()).bit_length()):
        block = place >> bit
        keys = np.sort(block * (n + 1) + rank)
        other = (block ^ 1) * (n + 1)
        first = np.searchsorted(keys, other)
        less = np.searchsorted(keys, other + lower) - first
        more = np.searchsorted(keys, other + n + 1) - np.searchsorted(keys, other + upto)
        out += np.where((block & 1 == 0) == below, less, more)
    return out


def repeated_median_slope_of(x: np.ndarray, y: np.ndarray) -> float:
    """Siegel's slope: the median over i of the median over j of the slopes between i and j; pairs of equal x are skipped.

    Beyond ALL_PAIRS points, the medians of a sample of them give two slopes
    that enclose the median of all.  Counts of slopes below and above those two,
    for all points at once, tell which points have their own median outside;
    the rest are few after some turns, and theirs are taken of all their slopes.
    The result is the same.
    """
    n = len(x)
    distinct, place, same = np.unique(x, return_inverse=True, return_counts=True)
    if len(distinct) < 2:
        return math.nan
    if n <= ALL_PAIRS:
        return float(np.median(_inner_medians(x, y, np.arange(n))))
    about = x - distinct[len(distinct) // 2]
    half = (n - same[place]) // 2 + 1
    left, below, above, wide = np.arange(n), 0, 0, 2.0
    first, last = (n - 1) // 2, n // 2
    draws = np.random.default_rng(0)
    while len(left) > ALL_PAIRS // 4 and wide < 2 * math.sqrt(SAMPLE):
        sample = np.sort(_inner_medians(x, y, draws.choice(left, SAMPLE)))
        low = int(SAMPLE * (first - below) / len(left) - wide * math.sqrt(SAMPLE) / 2)
        high = int(math.ceil(SAMPLE * (last - below) / len(left) + wide * math.sqrt(SAMPLE) / 2))
        down = (_surely(place, about, y, sample[low] if low >= 0 else -math.inf, True) >= half)[left]
        up = (_surely(place, about, y, sample[high] if high < SAMPLE else math.inf, False) >= half)[left]
        if below + down.sum() > first or above + up.sum() > n - 1 - last or (down | up).mean() < 0.1:
            wide *= 2
            continue
        below, above = below + int(down.sum()), above + int(up.sum())
        left = left[~(down | up)]
    found = np.sort(_inner_medians(x, y, left))
    return float(np.mean(found[[first - below, last - below]]))


def huber_line(x: np.ndarray, y: np.ndarray, k: float = 1.345, most: int = 50) -> tuple[float, float]:
    """Intercept and slope by Huber's weights, the scale being the residuals' MAD."""
    a = np.stack([np.ones_like(x), x], 1)
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    for _ in range(most):
        r = y - a @ beta
        s = np.median(np.abs(r - np.median(r))) / 0.6744897501960817
        if s <= 1e-12:
            break
        w = np.minimum(1, k / np.maximum(np.abs(r / s), 1e-300))
        new = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        done = np.abs(new - beta).max() < 1e-10 * max(1.0, np.abs(beta).max())
        beta = new
        if done:
            break
    return float(beta[0]), float(beta[1])


def line_intersection(m1: float, b1: float, m2: float, b2: float) -> tuple[float, float]:
    if m1 == m2:
        return math.nan, math.nan
    x = (b2 - b1) / (m1 - m2)
    return x, m1 * x + b1


def _row_medians(v: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each row, the median of its `count` values; the rest are infinite."""
    v, at = np.sort(v, axis=1), np.arange(len(v))
    return (v[at, (count - 1) // 2] + v[at, count // 2]) / 2


def huber_lines(x: np.ndarray, y: np.ndarray, first: np.ndarray, count: np.ndarray, k: float = 1.345, most: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and slopes of `huber_line` of many runs of the same points at once: `count` of them from `first` on.

    Lines are solved about their own weighted means, so that large x (seconds
    since an epoch) lose no digits; a run whose x are all equal is level.
    """
    at = np.minimum(first[:, None] + np.arange(count.max()), len(x) - 1)
    own = np.arange(count.max()) < count[:, None]
    u, v = x[at], y[at]

    def solved(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = w.sum(1)
        mu, mv = (w * u).sum(1) / whole, (w * v).sum(1) / whole
        d = u - mu[:, None]
        spread = (w * d * d).sum(1)
        slope = np.divide((w * d * (v - mv[:, None])).sum(1), spread, out=np.zeros(len(u)), where=spread > 0)
        return mv - slope * mu, slope

    b, m = solved(u, v, own.astype(float))
    left = np.arange(len(first))
    for _ in range(most):
        e, inside, n = v[left] - b[left, None] - m[left, None] * u[left], own[left], count[left]
        middle = _row_medians(np.where(inside, e, np.inf), n)
        s = _row_medians(np.where(inside, np.abs(e - middle[:, None]), np.inf), n) / 0.6744897501960817
        going = s > 1e-12
        left, e, inside, s = left[going], e[going], inside[going], s[going]
        if not len(left):
            break
        w = np.where(inside, np.minimum(1, k / np.maximum(np.abs(e / s[:, None]), 1e-300)), 0.0)
        nb, nm = solved(u[left], v[left], w)
        moved = np.maximum(np.abs(nb - b[left]), np.abs(nm - m[left])) >= 1e-10 * np.maximum(1.0, np.maximum(np.abs(b[left]), np.abs(m[left])))
        b[left], m[left] = nb, nm
        left = left[moved]
        if not len(left):
            break
    return b, m


def elbow_of(x: np.ndarray, y: np.ndarray, lines: int = 41) -> float:
    """The x nearest to the median meeting point of robust lines from both ends, of growing length; points of equal x in the order of y."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    n = len(x)
    if n < 5:
        return math.nan
    center, reach = float(x.mean()), float(x[-1] - x[0]) or 1.0
    u = (x - center) / reach
    sizes = np.unique(np.linspace(5, max(5, n // 2), lines).astype(int))
    at = []
    for some in np.array_split(sizes, min(len(sizes), max(1, len(sizes) * int(sizes[-1]) // CELLS))):
        b, m = huber_lines(u, y, np.concatenate([np.zeros_like(some), n - some]), np.concatenate([some, some]))
        b1, b2, m1, m2 = b[: len(some)], b[len(some) :], m[: len(some)], m[len(some) :]
        at.append(np.divide(b2 - b1, m1 - m2, out=np.full(len(some), np.nan), where=m1 != m2))
    at = np.concatenate(at)
    at = at[np.isfinite(at) & (at >= u[0]) & (at <= u[-1])]
    return float(x[np.abs(u - np.median(at)).argmin()]) if len(at) else math.nan
