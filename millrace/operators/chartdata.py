"""The data of charts as DataFrames: aggregates, grids and projections; drawing them is left to whoever shows them.

CHARTS names each kind.  What comes from rows of data is an aggregate or a
projection of all of them; what comes from a model is a grid that Spark makes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import distributions as D
from millrace.operators import latent, optimize, univariate
from millrace.operators.linear import OLS

CHARTS: dict[str, Callable[..., DataFrame]] = {}


def chart(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    CHARTS[f.__name__] = f
    return f


def create(kind: str, *args, **options) -> DataFrame:
    """The data of a kind of chart."""
    if kind not in CHARTS:
        raise ValueError(f"no such chart: {kind}; there are {', '.join(sorted(CHARTS))}")
    return CHARTS[kind](*args, **options)


@chart
def main_effects(df: DataFrame, response: str, factors: Sequence[str]) -> DataFrame:
    """factor, level, mean and n: all factors in one pass."""
    long = df.select(F.col(response).cast("double").alias("_y"), *(F.col(f).cast("string").alias(f) for f in factors)).unpivot(["_y"], list(factors), "factor", "level")
    return long.groupBy("factor", "level").agg(F.avg("_y").alias("mean"), F.count("_y").alias("n"))


@chart
def interactions(df: DataFrame, response: str, a: str, b: str) -> DataFrame:
    """Mean and n of each combination of two factors."""
    return df.groupBy(a, b).agg(F.avg(response).alias("mean"), F.count(response).alias("n"))


@chart
def corners(df: DataFrame, response: str, factors: Sequence[str], low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Mean and n at the corners of a square (two factors), cube (three) or more."""
    at = df
    for f in factors:
        at = at.filter(F.col(f).isin(low, high))
    return at.groupBy(*factors).agg(F.avg(response).alias("mean"), F.count(response).alias("n"))


@chart
def pareto(effects: DataFrame, term: str = "term", effect: str = "effect") -> DataFrame:
    """Effects by size, and the share of the sum that they and the larger ones have."""
    rows = sorted(((r[term], float(r[effect])) for r in effects.collect()), key=lambda r: (-abs(r[1]), r[0]))  # one row a term
    total, so_far, out = sum(abs(v) for _, v in rows) or 1.0, 0.0, []
    for k, (name, v) in enumerate(rows, 1):
        so_far += abs(v)
        out.append((k, name, v, abs(v), so_far / total))
    return effects.sparkSession.createDataFrame(out, f"position int, `{term}` string, effect double, size double, cumulative double")


@chart
def half_normal(effects: DataFrame, term: str = "term", effect: str = "effect", signed: bool = False) -> DataFrame:
    """Sizes of effects (or the effects, signed) against normal quantiles."""
    rows = sorted(((r[term], float(r[effect])) for r in effects.collect()), key=lambda r: r[1] if signed else abs(r[1]))  # one row a term
    m = len(rows)
    p = lambda i: (i - 0.5) / m if signed else 0.5 + 0.5 * (i - 0.5) / m
    return effects.sparkSession.createDataFrame([(name, v, abs(v), float(D.norm_ppf(p(i)))) for i, (name, v) in enumerate(rows, 1)], f"`{term}` string, effect double, size double, quantile double")


@chart
def box_cox_curve(df: DataFrame, response: str, lambdas: Sequence[float] | None = None) -> DataFrame:
    """The mean log likelihood of each power, in one aggregate."""
    grid = [round(float(x), 2) for x in (lambdas if lambdas is not None else np.linspace(-2, 2, 41))]
    rows = df.select(F.col(response).cast("double").alias("y")).filter("y > 0")
    moved = lambda g: F.log("y") if g == 0 else (F.pow("y", F.lit(g)) - 1) / g
    row = rows.agg(F.avg(F.log("y")), *(F.var_pop(moved(g)) for g in grid)).first()
    return df.sparkSession.createDataFrame([(g, -0.5 * math.log(v) + (g - 1) * row[0] if v and v > 0 else None) for g, v in zip(grid, row[1:], strict=True)], "lambda double, log_likelihood double")


@chart
def residuals(model: OLS, df: DataFrame, order: str | None = None) -> DataFrame:
    """Fitted value, residual and studentised residual of each row, and its place."""
    return model.residuals(df).select(*([order] if order else []), "y_hat", "residual", "studentised", "leverage", "cooks_distance")


@chart
def normal_probability(df: DataFrame, value: str) -> DataFrame:
    """Each value with its rank, plotting position and normal quantile; ranks are made over sorted ranges."""
    quantile = F.pandas_udf(lambda p: pd.Series([D.norm_ppf(float(x)) for x in p], dtype=float), "double")
    rows = univariate.ranked(univariate.present(df, value), [])
    n = rows.agg(F.count("x").alias("_n"))
    out = rows.crossJoin(F.broadcast(n)).withColumn("probability", (F.col("rank") - 0.375) / (F.col("_n") + 0.25))
    return out.select(F.col("x").alias(value), "rank", "probability", quantile("probability").alias("quantile"))


@chart
def perturbation(spark: SparkSession, surface: optimize.Surface, factors: Sequence[str], levels: int = 21, center: Mapping[str, float] | None = None) -> DataFrame:
    """The response along each factor, the others at the centre."""
    center = dict(center or {})
    rows = spark.range(levels).select((F.lit(-1.0) + F.col("id") * (2.0 / (levels - 1))).alias("coded"), F.explode(F.array(*(F.lit(f) for f in factors))).alias("factor"))
    at = rows.withColumns({f: F.when(F.col("factor") == f, F.col("coded")).otherwise(float(center.get(f, 0.0))) for f in factors})
    return at.select("factor", "coded", optimize.evaluate(surface).alias("response"))


@chart
def contour(spark: SparkSession, surface: optimize.Surface, bounds: Mapping[str, tuple[float, float]], levels: int = 21, hold: Mapping[str, float] | None = None) -> DataFrame:
    """The response over a grid of some factors, the others held; a surface plot has the same data."""
    at = optimize.grid(spark, bounds, levels).withColumns({f: F.lit(float(v)) for f, v in (hold or {}).items()})
    return at.select(*bounds, optimize.evaluate(surface).alias("response"))


@chart
def overlay(spark: SparkSession, surfaces: Mapping[str, optimize.Surface], limits: Mapping[str, tuple[float | None, float | None]], bounds: Mapping[str, tuple[float, float]], levels: int = 21) -> DataFrame:
    """Responses over a grid and whether all of them are within their limits."""
    out = optimize.grid(spark, bounds, levels).withColumns({r: optimize.evaluate(s) for r, s in surfaces.items()})
    inside = F.lit(True)
    for r, (low, high) in limits.items():
        inside = inside & (F.lit(True) if low is None else F.col(r) >= low) & (F.lit(True) if high is None else F.col(r) <= high)
    return out.withColumn("feasible", inside)


@chart
def desirability_contour(spark: SparkSession, surfaces: Mapping[str, optimize.Surface], goals: Mapping[str, Mapping], bounds: Mapping[str, tuple[float, float]], levels: int = 21) -> DataFrame:
    return optimize.scored(optimize.grid(spark, bounds, levels), surfaces, goals).select(*bounds, "desirability")


@chart
def ridge_trace(spark: SparkSession, surface: optimize.Surface, factors: Sequence[str], radii: Sequence[float], maximize: bool = True) -> DataFrame:
    rows = optimize.ridge_analysis(surface, factors, radii, maximize)
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(["radius double", *(f"`{f}` double" for f in factors), "response double"]))


@chart
def ascent_path(spark: SparkSession, surface: optimize.Surface, factors: Sequence[str], **how) -> DataFrame:
    rows = optimize.steepest_path(surface, factors, **how)
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(["step int", *(f"`{f}` double" for f in factors), "response double"]))


@chart
def prediction_variance(spark: SparkSession, model: OLS, bounds: Mapping[str, tuple[float, float]], levels: int = 21) -> DataFrame:
    """The variance of a prediction over that of an observation, over a grid of a model without products of factors."""
    return optimize.grid(spark, bounds, levels).select(*bounds, model.leverage().alias("variance"))


@chart
def fraction_of_design_space(spark: SparkSession, model: OLS, bounds: Mapping[str, tuple[float, float]], levels: int = 21) -> DataFrame:
    """The share of a grid of the region whose prediction variance is at most each value."""
    rows = univariate.ranked(prediction_variance(spark, model, bounds, levels).select(F.col("variance").alias("x")), [])
    return rows.select((F.col("rank") / float(levels ** len(bounds))).alias("fraction"), F.col("x").alias("variance"))


@chart
def scores(model: latent.PCA | latent.PLS, df: DataFrame) -> DataFrame:
    """df with its scores, T2 and SPE, and both limits: score, T2 and SPE charts."""
    return model.diagnose(df).withColumn("t2_limit", F.lit(float(model.t2_limit()))).withColumn("spe_limit", F.lit(float(model.spe_limit())))


@chart
def loadings(spark: SparkSession, model: latent.PCA | latent.PLS) -> DataFrame:
    """A row a variable, a column a component."""
    names = model.columns if isinstance(model, latent.PCA) else model.x
    return spark.createDataFrame([(n, *map(float, r)) for n, r in zip(names, model.loadings, strict=True)], ", ".join(["variable string", *(f"p{a + 1} double" for a in range(model.components))]))


@chart
def correlation_loadings(model: latent.PCA, df: DataFrame) -> DataFrame:
    """Correlations of the variables with the scores."""
    found = latent.project_variables(model, df, model.columns)
    return df.sparkSession.createDataFrame([(c, *map(float, v)) for c, v in found.items()], ", ".join(["variable string", *(f"t{a + 1} double" for a in range(model.components))]))


@chart
def explained_variance(spark: SparkSession, model: latent.PCA) -> DataFrame:
    return spark.createDataFrame(model.eigenvalues(), "component int, eigenvalue double, percent double, cumulative double")


@chart
def coefficients(spark: SparkSession, model: latent.PLS, response: int = 0) -> DataFrame:
    return spark.createDataFrame([(c, float(b)) for c, b in zip(model.x, model.beta[:, response], strict=True)], "variable string, coefficient double")


@chart
def predictions_vs_observed(model: latent.PLS, df: DataFrame, response: int = 0) -> DataFrame:
    y = model.y[response]
    return model.predict(df).select(F.col(y).alias("observed"), F.col(f"{y}_hat").alias("predicted"))


@chart
def batches_per_tag(df: DataFrame, batch: str, order: str, tags: Sequence[str]) -> DataFrame:
    """One value a row: batch, place within it, tag, value."""
    from pyspark.sql import Window as W

    placed = df.withColumn("position", F.row_number().over(W.partitionBy(batch).orderBy(order)) - 1)
    return placed.select(batch, "position", *(F.col(t).cast("double").alias(t) for t in tags)).unpivot([batch, "position"], list(tags), "tag", "value")


@chart
def raincloud(df: DataFrame, value: str, by: Sequence[str], bins: int = 20) -> DataFrame:
    """A histogram of each group over its range: group, bin, from, to, n and the share of the group's values."""
    x = univariate.present(df, value, by)
    edges = x.groupBy(*by).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("whole"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("low")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    out = x.join(F.broadcast(edges), list(by)).groupBy(*by, at.alias("bin"), "low", "high", "whole").agg(F.count("*").alias("n"))
    return out.select(*by, "bin", (F.col("low") + F.col("bin") * width).alias("start"), (F.col("low") + (F.col("bin") + 1) * width).alias("end"), "n", (F.col("n") / F.col("whole")).alias("share"))
