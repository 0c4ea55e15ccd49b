"""One entry for the analysis of an experiment: a formula, one fit from one pass of moments, and the analyses asked for.

Designs have tens of rows, but nothing here depends on it: the fit is an
aggregate, diagnostics of rows are projections, and sums over them aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import distributions as D
from millrace.operators import doe, experiments
from millrace.operators.linear import OLS, lm, terms_of, with_terms

#: Transformations of the response by name.
TRANSFORMS = {"log": F.log, "sqrt": F.sqrt, "inverse": lambda c: F.lit(1.0) / c}


def build_formula(response: str, factors: Sequence[str], model: str | None = None) -> str:
    """The formula of main_effects, interactions (the default) or quadratic; a right-hand side or a whole formula is taken as it is."""
    sides = {
        "main_effects": " + ".join(factors),
        "interactions": f"({' + '.join(factors)}) ** 2",
        "quadratic": " + ".join([f"({' + '.join(factors)}) ** 2", *(f"I({f} ** 2)" for f in factors)]),
    }
    model = model or "interactions"
    return model if "~" in model else f"{response} ~ {sides.get(model, model)}"


@dataclass
class AnalysisResult:
    """A fit, its formula, and what was asked for by name."""

    model: OLS
    formula: str
    terms: list[tuple[str, ...]]
    results: dict = field(default_factory=dict)

    def frame(self, df: DataFrame) -> DataFrame:
        """df with a column for each product of factors in the model."""
        return with_terms(df, self.terms)[0]

    def predict(self, points: DataFrame, conflevel: float | None = None) -> DataFrame:
        """points with predicted, and confidence and prediction intervals."""
        m = self.model
        c = float(D.t_ppf(0.5 + (conflevel or m.conflevel) / 2, m.dof))
        s2 = m.rss / m.dof
        out = self.frame(points).withColumns({"predicted": m.predicted(), "_h": m.leverage()})
        mean, one = c * F.sqrt(s2 * F.col("_h")), c * F.sqrt(s2 * (1 + F.col("_h")))
        return out.select(*points.columns, "predicted", (F.col("predicted") - mean).alias("ci_low"), (F.col("predicted") + mean).alias("ci_high"), (F.col("predicted") - one).alias("pi_low"), (F.col("predicted") + one).alias("pi_high"))

    def confirm(self, points: DataFrame, observed: str, conflevel: float | None = None) -> DataFrame:
        """predict() and whether each observed value is within its prediction interval."""
        return self.predict(points, conflevel).withColumn("within_pi", F.col(observed).between(F.col("pi_low"), F.col("pi_high")))


def summary_of(result: AnalysisResult, df: DataFrame, y: str) -> dict:
    """R2, adjusted and predicted R2, and adequate precision, by one aggregate over the rows."""
    m = result.model
    rows = result.frame(df).withColumns({"_hat": m.predicted(), "_h": m.leverage()})
    press, high, low = rows.agg(F.sum(((F.col(y) - F.col("_hat")) / (1 - F.col("_h"))) ** 2), F.max("_hat"), F.min("_hat")).first()
    s = m.summary()
    noise = math.sqrt(len(m.beta) * m.rss / m.dof / m.n) if m.dof else math.nan
    return {"r2": s["r2"], "adjusted_r2": s["adjusted_r2"], "predicted_r2": 1 - press / m.tss if m.tss > 0 else 0.0, "adequate_precision": (high - low) / noise if noise > 0 else math.inf, "standard_error": s["standard_error"], "n": m.n, "dof": m.dof}


def transformed(df: DataFrame, response: str, transform: str | None) -> tuple[DataFrame, dict]:
    """df with the response transformed, and what was done."""
    if transform is None:
        return df, {}
    if transform == "box_cox":
        power = experiments.box_cox(df, response)["lambda"]
        y = F.col(response).cast("double")
        return df.withColumn(response, F.log(y) if power == 0 else (F.pow(y, F.lit(power)) - 1) / power), {"transform": transform, "lambda": power}
    return df.withColumn(response, TRANSFORMS[transform](F.col(response).cast("double"))), {"transform": transform}


def analyze_experiment(
    df: DataFrame,
    response: str,
    factors: Sequence[str],
    model: str | None = None,
    analyses: Sequence[str] = ("anova",),
    transform: str | None = None,
    alpha: float = 0.05,
    points: DataFrame | None = None,
    observed: str | None = None,
) -> AnalysisResult:
    """Fit the model and run anova, effects, coefficients, significance, confidence_intervals, residual_diagnostics, lack_of_fit, curvature, model_selection, box_cox, lenth, prediction, confirmation and summary, as asked for."""
    own, done = transformed(df, response, transform)
    formula = build_formula(response, factors, model)
    y, terms = terms_of(formula, own.columns)
    fit = lm(own, formula, alias_threshold=0.999999, conflevel=1 - alpha)
    result = AnalysisResult(fit, formula, terms, done | {"aliased": fit.aliased})
    s = fit.summary()
    named = list(zip(s["names"], s["coefficients"], s["standard_errors"], s["t_values"], s["p_values"], s["conf_intervals"], strict=True))

    def diagnostics() -> dict:
        rows = fit.residuals(result.frame(own))
        order = "RunOrder" if "RunOrder" in own.columns else factors[0]
        row = rows.agg(F.max("leverage"), F.max("cooks_distance"), F.max(F.abs("studentised"))).first()
        return experiments.residual_tests(rows, "residual", order, "y_hat") | dict(zip(("max_leverage", "max_cooks_distance", "max_studentised"), row, strict=True))

    run = {
        "anova": lambda: experiments.anova(own, formula),
        "effects": lambda: {n: 2 * b for n, b, *_ in named if n != "(Intercept)"},
        "coefficients": lambda: [dict(zip(("term", "coefficient", "standard_error", "t", "p_value"), x, strict=False)) for x in named],
        "significance": lambda: {"significant": [n for n, _, _, _, p, _ in named[1:] if p < alpha], "not_significant": [n for n, _, _, _, p, _ in named[1:] if not p < alpha]},
        "confidence_intervals": lambda: {n: ci for n, *_, ci in named},
        "residual_diagnostics": diagnostics,
        "lack_of_fit": lambda: doe.lack_of_fit(fit.predict(result.frame(own)), y, "y_hat", factors, len(fit.beta)),
        "curvature": lambda: experiments.curvature(own, y, factors),
        "model_selection": lambda: experiments.select_model(own, formula),
        "box_cox": lambda: experiments.box_cox(df, response),
        "lenth": lambda: doe.lenth([2 * b for n, b, *_ in named if n != "(Intercept)"], alpha),
        "prediction": lambda: result.predict(points),
        "confirmation": lambda: result.confirm(points, observed),
        "summary": lambda: summary_of(result, own, y),
    }
    unknown = set(analyses) - set(run)
    if unknown:
        raise ValueError(f"no such analyses: {sorted(unknown)}")
    result.results |= {a: run[a]() for a in analyses}
    return result


def coded(column: str | Column, low: float, high: float) -> Column:
    """A factor's actual units to -1..1."""
    c = F.col(column) if isinstance(column, str) else column
    return (c - (low + high) / 2) / ((high - low) / 2)


def actual(column: str | Column, low: float, high: float) -> Column:
    """-1..1 back to a factor's actual units."""
    c = F.col(column) if isinstance(column, str) else column
    return c * ((high - low) / 2) + (low + high) / 2
