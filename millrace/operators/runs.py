"""Evaluation of a table of runs as a design: any number of rows, from one table of moments of its terms.

Terms are main effects, interactions of two factors (A:B) and squares (A^2).
The information matrix X'X of a model, with its constant, is made of sums and
sums of products; whatever follows from it needs no further pass.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.linear import moments

MODELS = {"linear": (False, False), "interactions": (True, False), "quadratic": (True, True)}


def terms_of(factors: Sequence[str], model: str) -> dict[str, tuple[str, ...]]:
    """Names of a model's terms without the constant, and the factors of each."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    crossed, squared = MODELS[model]
    out = {f: (f,) for f in factors}
    if crossed:
        out |= {f"{a}:{b}": (a, b) for a, b in itertools.combinations(factors, 2)}
    if squared:
        out |= {f"{a}^2": (a, a) for a in factors}
    return out


def product(parts: Sequence[str]) -> Column:
    out = F.col(parts[0]).cast("double")
    for p in parts[1:]:
        out = out * F.col(p).cast("double")
    return out


@dataclass
class Runs:
    """Moments of all terms up to second order of a table of runs; rows with a missing factor are left out."""

    factors: list[str]
    n: int
    terms: list[str]
    #: X'X with the constant first, and sums of products of terms about their means.
    information: np.ndarray
    centred: np.ndarray
    settings: int

    @classmethod
    def of(cls, df: DataFrame, factors: Sequence[str]) -> Runs:
        factors = list(factors)
        terms = terms_of(factors, "quadratic")
        names = [f"_t{i}" for i in range(len(terms))]
        rows = df.select(*(F.col(f).cast("double").alias(f) for f in factors)).dropna()
        m = moments(rows.select(*(product(p).alias(n) for n, p in zip(names, terms.values(), strict=True))), names)
        _, sums, products = m.raw
        settings = rows.groupBy(*(F.round(f, 8).alias(f) for f in factors)).agg(F.lit(1)).count()
        return cls(factors, m.n, list(terms), np.block([[np.array([[m.n]]), sums[None]], [sums[:, None], products]]), m.centred, settings)

    def _places(self, model: str) -> list[int]:
        return [self.terms.index(t) for t in terms_of(self.factors, model)]

    def model(self, model: str) -> np.ndarray:
        """X'X of a model."""
        at = [0, *(i + 1 for i in self._places(model))]
        return self.information[np.ix_(at, at)]

    def evaluate(self, model: str = "linear") -> dict[str, object]:
        """Efficiencies (percent), optimality values, condition number of X, inflation of each term's variance and degrees of freedom."""
        x = self.model(model)
        p = len(x)
        out: dict[str, object] = {"n": self.n, "p": p}
        scale = np.sqrt(np.maximum(np.diag(x), 1e-300))
        if self.n < p or np.linalg.eigvalsh(x / np.outer(scale, scale))[0] < 1e-10:
            return out | {"singular": True}
        values = np.linalg.eigvalsh(x)
        inverse = np.linalg.inv(x)
        at = self._places(model)
        c = self.centred[np.ix_(at, at)]
        return out | {
            "singular": False,
            "d_efficiency": float(100 * np.exp(np.linalg.slogdet(x)[1] / p) / self.n),
            "a_optimality": float(np.trace(inverse)),
            "e_optimality": float(values[0]),
            "condition_number": math.sqrt(values[-1] / values[0]),
            "vif": dict(zip(terms_of(self.factors, model), (np.diag(np.linalg.inv(c)) * np.diag(c)).tolist(), strict=True)),
            "degrees_of_freedom": {"model": p - 1, "residual": self.n - p, "pure_error": self.n - self.settings, "lack_of_fit": self.settings - p},
        }

    def correlations(self) -> dict[tuple[str, str], float]:
        """Correlations of second-order terms beside what the constant and the main effects tell of them; 0 for a term without any of its own."""
        k = len(self.factors)
        c = self.centred
        left = c[k:, k:] - c[k:, :k] @ np.linalg.pinv(c[:k, :k], rcond=1e-12, hermitian=True) @ c[:k, k:]
        own = np.diag(left) > 1e-10 * np.maximum(np.diag(c)[k:], 1e-300)
        d = np.sqrt(np.where(own, np.diag(left), 1.0))
        r = np.where(np.outer(own, own), left / np.outer(d, d), 0.0)
        return {(self.terms[k + i], self.terms[k + j]): float(r[i, j]) for i in range(len(r)) for j in range(i + 1, len(r))}

    def confounding(self, tolerance: float = 1e-9) -> dict[str, list[str]]:
        """Main effects and interactions that vary exactly together, with their signs: what an effect cannot be told apart from."""
        names = list(terms_of(self.factors, "interactions"))
        at = [self.terms.index(t) for t in names]
        c = self.centred[np.ix_(at, at)]
        d = np.sqrt(np.maximum(np.diag(c), 1e-300))
        r = c / np.outer(d, d)
        live = np.diag(c) > 1e-10 * max(self.n, 1)
        return {a: same for i, a in enumerate(names) if (same := [("-" if r[i, j] < 0 else "+") + b for j, b in enumerate(names) if i != j and live[i] and live[j] and abs(r[i, j]) >= 1 - tolerance])}

    def alias_matrix(self, fitted: str = "linear", full: str = "interactions") -> dict[tuple[str, str], float]:
        """How much of each term that is left out of the fitted model goes to each of its coefficients."""
        inside, every = ["(Intercept)", *terms_of(self.factors, fitted)], ["(Intercept)", *terms_of(self.factors, full)]
        place = {t: 0 if t == "(Intercept)" else self.terms.index(t) + 1 for t in every}
        out = [t for t in every if t not in inside]
        a = [place[t] for t in inside]
        b = [place[t] for t in out]
        m = np.linalg.pinv(self.information[np.ix_(a, a)], rcond=1e-12, hermitian=True) @ self.information[np.ix_(a, b)]
        return {(s, t): float(m[i, j]) for i, s in enumerate(inside) for j, t in enumerate(out)}

    def prediction_variance(self, points: DataFrame, model: str = "linear", name: str = "variance") -> DataFrame:
        """points and the variance of a prediction there, in units of the error's: x (X'X)^-1 x'; plain columns."""
        inverse = np.linalg.inv(self.model(model))
        x = [F.lit(1.0), *(product(p) for p in terms_of(self.factors, model).values())]
        total = F.lit(0.0)
        for i in range(len(x)):
            for j in range(i, len(x)):
                total = total + x[i] * x[j] * float(inverse[i, j] * (1 if i == j else 2))
        return points.withColumn(name, total)

    def g_efficiency(self, df: DataFrame, model: str = "linear") -> float:
        """100 p / (n times the largest variance of a prediction at the runs of df)."""
        most = self.prediction_variance(df.dropna(subset=self.factors), model, "_v").agg(F.max("_v")).first()[0]
        return 100 * len(self.model(model)) / (self.n * most) if most else math.nan
