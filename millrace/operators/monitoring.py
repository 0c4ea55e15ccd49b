"""Control charts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.univariate import with_median

LAMBDAS = (0.1, 0.3, 0.5, 0.7, 0.9)


def shewhart_limits(df: DataFrame, value: str, by: Sequence[str] = (), style: str = "regular") -> DataFrame:
    """target, s and the three-sigma limits of each group: mean and deviation, or median and 1.4826 MAD."""
    x = df.select(*by, F.col(value).alias("x")).filter(F.col("x").isNotNull())
    if style == "regular":
        out = x.groupBy(*by).agg(F.avg("x").alias("target"), F.stddev_samp("x").alias("s"))
    else:
        out = with_median(x, by).groupBy(*by).agg(F.max("m").alias("target"), (1.4826 * F.median(F.abs(F.col("x") - F.col("m")))).alias("s"))
    return out.withColumn("lcl", F.col("target") - 3 * F.col("s")).withColumn("ucl", F.col("target") + 3 * F.col("s"))


def shewhart(df: DataFrame, value: str, by: Sequence[str] = (), style: str = "regular") -> DataFrame:
    """df with its group's limits and whether a value is beyond them (strictly)."""
    limits = shewhart_limits(df, value, by, style)
    out = df.join(limits, list(by)) if by else df.crossJoin(F.broadcast(limits))
    return out.withColumn("out_of_control", F.abs(F.col(value) - F.col("target")) > 3 * F.col("s"))


#: Where the bi-weight loss stops growing, and what makes it consistent for normal values.
BIWEIGHT_REACH, BIWEIGHT_CONSISTENCY = 2.52, 3.2667


def rho(x: np.ndarray, k: float = BIWEIGHT_REACH, consistency: float = BIWEIGHT_CONSISTENCY) -> np.ndarray:
    """The bounded bi-weight loss."""
    return np.where(np.abs(x) <= k, consistency * (1 - (1 - np.square(x / k)) ** 3), consistency)


def psi(x: float, k: float = 2.0) -> float:
    return max(-k, min(k, x))


def holt_winters(y: np.ndarray, level_rate: float, slope_rate: float, spread_rate: float, warm: int) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors and running scales of the robust recursion.

    A line through the warm-up begins it.  A value further than two scales from
    its forecast counts as two scales away; a missing one changes nothing.
    """
    head = y[:warm]
    known = np.flatnonzero(~np.isnan(head))
    trend, level = np.polyfit(known, head[known], 1) if len(known) > 1 else (0.0, np.nanmean(head))
    residual = head[known] - (level + trend * known)
    scale = 1.48 * np.median(np.abs(residual)) or residual.std() or 1e-9
    level += trend * (warm - 1)
    errors, scales, seen = np.full(len(y), np.nan), np.full(len(y), scale), list(np.abs(residual))
    for i in range(warm, len(y)):
        forecast = level + trend
        error = y[i] - forecast
        if math.isnan(error):
            error = 0.0
            scales[i] = 1.48 * float(np.median(seen[-10:])) or scale
        else:
            errors[i] = error
            scale = math.sqrt(spread_rate * float(rho(np.array(error / scale))) * scale**2 + (1 - spread_rate) * scale**2)
            scales[i] = scale
            seen.append(abs(error))
        clean = forecast + psi(error / scales[i]) * scales[i]
        before = level
        level = level_rate * clean + (1 - level_rate) * forecast
        trend = slope_rate * (level - before) + (1 - slope_rate) * trend
    return errors, scales


def fit_holt_winters(y: np.ndarray, spread_rate: float = 0.3) -> tuple[float, float, int]:
    """The rates of a grid with the least robust loss, and the length of the warm-up."""
    warm = min(20, max(10, math.ceil(0.1 * len(y))))
    best = (math.inf, 0.0, 0.0)
    for a in LAMBDAS:
        for b in LAMBDAS:
            e = holt_winters(y, a, b, spread_rate, warm)[0]
            e = e[~np.isnan(e)]
            if not len(e):
                continue
            s = 1.48 * np.median(np.abs(e)) or 1e-9
            best = min(best, (float(s * s * rho(e / s).mean()), a, b))
    return best[1], best[2], warm


def holt_winters_chart(df: DataFrame, value: str, order: str, by: Sequence[str], rates: tuple[float, float] | None = None) -> DataFrame:
    """Each ordered value of a group with its forecast error, scale and flag; a series is one task's, and too short ones have no flags."""
    kinds = dict(df.dtypes)

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_order")
        y = f["_y"].to_numpy(float)
        out = pd.DataFrame({**dict(zip(by, key, strict=True)), "position": np.arange(len(y)), "value": y, "error": np.nan, "scale": np.nan, "out_of_control": False})
        if (~np.isnan(y)).sum() > 12:
            a, b, warm = fit_holt_winters(y) if rates is None else (*rates, min(20, max(10, math.ceil(0.1 * len(y)))))
            errors, scales = holt_winters(y, a, b, 0.3, warm)
            out["error"], out["scale"] = errors, scales
            out["out_of_control"] = np.abs(np.nan_to_num(errors)) > 3 * scales
        return out

    own = df.select(*by, F.col(order).alias("_order"), F.col(value).cast("double").alias("_y"))
    return own.groupBy(*by).applyInPandas(one, ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "position int, value double, error double, scale double, out_of_control boolean"]))
