"""Optimisation of fitted responses: polynomial surfaces scored as columns over grids of settings that Spark makes.

A surface is a dict from terms (tuples of factor names, () for the constant) to
coefficients.  A search scores a whole grid of the region at once and then finer
grids around the best setting; only best rows reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.linear import OLS
from millrace.sources.tables import written

Surface = Mapping[tuple[str, ...], float]


def surface_of(model: OLS) -> dict[tuple[str, ...], float]:
    """The surface of a fit by formula."""
    out = {}
    for name, b in zip(model.names, model.beta, strict=True):
        if name == "(Intercept)":
            term = ()
        elif name.startswith("I("):
            base, power = name[2:-1].split(" ** ")
            term = (base,) * int(power)
        else:
            term = tuple(name.split(":"))
        out[term] = float(b)
    return out


def evaluate(surface: Surface) -> Column:
    """A surface at each row's settings."""
    out = F.lit(0.0)
    for term, b in surface.items():
        x = F.lit(float(b))
        for f in term:
            x = x * F.col(f)
        out = out + x
    return out


def quadratic_form(surface: Surface, factors: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """b and B of b'x + x'Bx."""
    at = {f: i for i, f in enumerate(factors)}
    b, q = np.zeros(len(factors)), np.zeros((len(factors),) * 2)
    for term, v in surface.items():
        if len(term) == 1:
            b[at[term[0]]] += v
        elif len(term) == 2:
            i, j = at[term[0]], at[term[1]]
            q[i, j] += v / 2
            q[j, i] += v / 2
    return b, q


def desirability(value: Column, goal: Mapping) -> Column:
    """One response's desirability: maximize and minimize between low and high, target between them, to the power weight."""
    low, high, weight = float(goal["low"]), float(goal["high"]), float(goal.get("weight", 1.0))
    clip = lambda c: F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), F.lit(weight))
    if goal["goal"] == "maximize":
        return clip((value - low) / (high - low))
    if goal["goal"] == "minimize":
        return clip((high - value) / (high - low))
    target = float(goal["target"])
    return F.when(value <= target, clip((value - low) / (target - low) if target > low else F.lit(1.0))).otherwise(clip((high - value) / (high - target) if high > target else F.lit(1.0)))


def composite(values: Sequence[Column], importance: Sequence[float] | None = None) -> Column:
    """The weighted geometric mean, nought if any is."""
    w = list(importance or [1.0] * len(values))
    logs, none = F.lit(0.0), F.lit(False)
    for v, k in zip(values, w, strict=True):
        logs, none = logs + float(k) * F.log(F.greatest(v, F.lit(1e-300))), none | (v <= 0)
    return F.when(none, 0.0).otherwise(F.exp(logs / float(sum(w))))


def grid(spark: SparkSession, bounds: Mapping[str, tuple[float, float]], levels: int) -> DataFrame:
    """Every combination of `levels` equally spaced settings of each factor: digits of one range of numbers, no join."""
    out = spark.range(levels ** len(bounds))
    steps = {}
    for i, (f, (low, high)) in enumerate(bounds.items()):
        digit = F.floor(F.col("id") / levels**i) % levels
        steps[f] = F.lit(float(low)) + digit * ((high - low) / (levels - 1))
    return out.select(*(c.alias(f) for f, c in steps.items()))


def scored(points: DataFrame, surfaces: Mapping[str, Surface], goals: Mapping[str, Mapping], importance: Mapping[str, float] | None = None) -> DataFrame:
    """points with each response, its desirability d_<response>, and the composite one."""
    out = points.withColumns({r: evaluate(s) for r, s in surfaces.items()})
    out = out.withColumns({f"d_{r}": desirability(F.col(r), goals[r]) for r in surfaces})
    return out.withColumn("desirability", composite([F.col(f"d_{r}") for r in surfaces], [float((importance or {}).get(r, 1.0)) for r in surfaces]))


def optimize_desirability(spark: SparkSession, surfaces: Mapping[str, Surface], goals: Mapping[str, Mapping], bounds: Mapping[str, tuple[float, float]], levels: int = 11, rounds: int = 6, importance: Mapping[str, float] | None = None) -> dict:
    """The setting of the largest composite desirability: the best of a grid of the region, then of ever finer grids around it."""
    if set(goals) != set(surfaces):
        raise ValueError("goals and surfaces must name the same responses")
    own, best = dict(bounds), None
    for _ in range(rounds):
        order = [F.desc("desirability"), *bounds]
        row = scored(grid(spark, own, levels), surfaces, goals, importance).orderBy(*order).first().asDict()
        if best is None or row["desirability"] > best["desirability"]:
            best = row
        wide = {f: (hi - lo) / (levels - 1) * 1.5 for f, (lo, hi) in own.items()}
        own = {f: (max(bounds[f][0], best[f] - wide[f]), min(bounds[f][1], best[f] + wide[f])) for f in bounds}
    return best


def pareto_front(points: DataFrame, responses: Mapping[str, str]) -> DataFrame:
    """The points that no other one equals or betters in every response and betters in one; responses: maximize or minimize.

    Each task keeps its own best points; what they leave is dealt to ever fewer
    tasks, a quarter as many each time, until one has the whole front.
    """
    signs = np.array([1.0 if how == "maximize" else -1.0 for how in responses.values()])

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front = None
        for f in frames:
            both = f if front is None else pd.concat([front, f], ignore_index=True)
            y = both[list(responses)].to_numpy(float) * signs
            order = np.lexsort(tuple(-y[:, k] for k in reversed(range(y.shape[1]))))  # a point is only beaten by earlier ones
            chosen: list[int] = []
            for i in order:
                own = y[chosen]
                if not len(own) or not ((own >= y[i]).all(axis=1) & (own > y[i]).any(axis=1)).any():
                    chosen.append(i)
            front = both.iloc[sorted(chosen)]
        if front is not None:
            yield front

    front = written(points.mapInPandas(keep, points.schema))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        parts = max(1, parts // 4)
        front = written(front.repartition(parts).mapInPandas(keep, points.schema))
    return front


def ridge_analysis(surface: Surface, factors: Sequence[str], radii: Sequence[float], maximize: bool = True) -> list[dict]:
    """The best setting at each distance from the centre, by Lagrange's condition (B - m I) x = -b / 2 with m beyond the eigenvalues."""
    b, q = quadratic_form(surface, factors)
    sign = 1.0 if maximize else -1.0
    values = np.linalg.eigvalsh(sign * q)
    at = lambda m: np.linalg.solve(sign * q - m * np.eye(len(b)), -sign * b / 2)
    out = []
    for r in radii:
        low, high = values[-1] + 1e-9, values[-1] + 1.0
        while np.linalg.norm(at(high)) > r:
            high = values[-1] + 2 * (high - values[-1])
        for _ in range(200):
            m = (low + high) / 2
            low, high = (m, high) if np.linalg.norm(at(m)) > r else (low, m)
        x = at(high)
        out.append({"radius": float(r), **{f: float(v) for f, v in zip(factors, x, strict=True)}, "response": float(surface.get((), 0.0) + b @ x + x @ q @ x)})
    return out


def canonical_analysis(surface: Surface, factors: Sequence[str]) -> dict:
    """Eigenvalues and axes of the quadratic part, the stationary point, the response there and what it is."""
    b, q = quadratic_form(surface, factors)
    values, vectors = np.linalg.eigh(q)
    if np.abs(values).min() < 1e-12 * max(1.0, np.abs(values).max()):
        return {"kind": "ridge", "eigenvalues": values.tolist(), "axes": vectors.T.tolist()}
    x = np.linalg.solve(q, -b / 2)
    kind = "maximum" if (values < 0).all() else "minimum" if (values > 0).all() else "saddle"
    return {"kind": kind, "eigenvalues": values.tolist(), "axes": vectors.T.tolist(), "x": dict(zip(factors, x.tolist(), strict=True)), "response": float(surface.get((), 0.0) + b @ x / 2)}


def steepest_path(surface: Surface, factors: Sequence[str], step: float = 0.5, steps: int = 10, ascend: bool = True) -> list[dict]:
    """Settings along the gradient at the centre, and the response there."""
    b, q = quadratic_form(surface, factors)
    if not np.linalg.norm(b) > 0:
        raise ValueError("the surface has no slope at the centre")
    g = b / np.linalg.norm(b) * (1 if ascend else -1)
    return [{"step": k, **{f: float(v) for f, v in zip(factors, k * step * g, strict=True)}, "response": float(surface.get((), 0.0) + b @ (k * step * g) + (k * step * g) @ q @ (k * step * g))} for k in range(steps + 1)]


def optimize_responses(spark: SparkSession, models: Mapping[str, OLS | Surface], bounds: Mapping[str, tuple[float, float]], method: str = "desirability", goals: Mapping[str, Mapping] | None = None, **options) -> dict | list[dict]:
    """desirability, steepest_ascent, steepest_descent, stationary_point, canonical_analysis, ridge or pareto; all but the first and last take one model."""
    surfaces = {r: surface_of(m) if isinstance(m, OLS) else m for r, m in models.items()}
    factors, only = list(bounds), next(iter(surfaces.values()))
    if method == "desirability":
        return optimize_desirability(spark, surfaces, goals or {}, bounds, **options)
    if method in ("steepest_ascent", "steepest_descent"):
        return steepest_path(only, factors, ascend=method == "steepest_ascent", **options)
    if method in ("stationary_point", "canonical_analysis"):
        out = canonical_analysis(only, factors)
        inside = "x" in out and all(lo <= out["x"][f] <= hi for f, (lo, hi) in bounds.items())
        return out | {"inside": inside}
    if method == "ridge":
        radii = options.pop("radii", np.linspace(0, math.sqrt(len(factors)), 11)[1:])
        return ridge_analysis(only, factors, radii, **options)
    if method == "pareto":
        points = grid(spark, bounds, options.get("levels", 11)).withColumns({r: evaluate(s) for r, s in surfaces.items()})
        return [r.asDict() for r in pareto_front(points, {r: g["goal"] for r, g in (goals or {}).items()}).collect()]
    raise ValueError(f"no such method: {method}")
