"""Cross products, least squares and robust lines.

A fit over any number of rows is one aggregate of sums of products (columns are
few), then a small solve on the driver, then projections.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import distributions as D
from millrace.operators.robust import repeated_median_slope_of
from millrace.sources.tables import dealt

#: Columns up to which products are plain aggregates; beyond, tasks multiply blocks of rows.
PLAIN_COLUMNS = 24


#: Rows whose means stand in for those of all, so that products are small numbers.
PILOT = 1000


@dataclass
class Moments:
    """Rows, and sums and sums of products of columns less a pivot near their means: sums of such tables add up, and centring loses no digits."""

    n: int
    pivot: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.pivot + self.sums / max(self.n, 1)

    @property
    def centred(self) -> np.ndarray:
        """Sums of products about the means."""
        return self.products - np.outer(self.sums, self.sums) / max(self.n, 1)

    @property
    def raw(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Rows, sums and sums of products of the columns as they are."""
        cross = np.outer(self.sums, self.pivot)
        return self.n, self.sums + self.n * self.pivot, self.products + cross + cross.T + self.n * np.outer(self.pivot, self.pivot)


def pilot(rows: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Means of columns over at most PILOT rows: where products are centred before they are summed."""
    row = rows.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).dropna().limit(PILOT).agg(*(F.avg(f"c{i}") for i in range(len(columns)))).first()
    return np.nan_to_num(np.array([x or 0.0 for x in row]), posinf=0.0, neginf=0.0)


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Moments of columns over rows without a missing value, in one pass."""
    k, pivot = len(columns), pilot(df, columns)
    rows = df.select(*((F.col(c).cast("double") - float(v)).alias(f"c{i}") for i, (c, v) in enumerate(zip(columns, pivot, strict=True)))).dropna()
    if k <= PLAIN_COLUMNS:
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = rows.agg(F.count(F.lit(1)), *(F.sum(f"c{i}") for i in range(k)), *(F.sum(F.col(f"c{i}") * F.col(f"c{j}")) for i, j in pairs)).first()
        products = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[k + 1 :], strict=True):
            products[i, j] = products[j, i] = x or 0.0
        return Moments(row[0], pivot, np.array([x or 0.0 for x in row[1 : k + 1]]), products)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *(c.to_numpy(zero_copy_only=False) for c in b.columns)])
            total += x.T @ x
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "x"])

    # (k + 1)(k + 2) / 2 sums, whatever the rows
    out = np.zeros((k + 1, k + 1))
    for r in rows.mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["x"]
    return Moments(int(out[0, 0]), pivot, out[0, 1:], out[1:, 1:])


def gram(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums, and sums of products of columns, over rows without a missing value."""
    return moments(df, columns).raw


def dot(columns: Sequence[str], weights: Sequence[float], constant: float = 0.0) -> Column:
    """A linear combination of columns."""
    out = F.lit(float(constant))
    for c, w in zip(columns, weights, strict=True):
        out = out + F.col(c) * float(w)
    return out


@dataclass
class OLS:
    """Least squares of y on columns, with the usual inference; rows with a missing value are left out."""

    y: str
    columns: list[str]
    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    n: int
    dof: int
    rss: float
    tss: float
    conflevel: float = 0.95
    aliased: dict[str, str] = field(default_factory=dict)
    #: What the model is written about: the means with an intercept, else zeros.
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    inverse: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @classmethod
    def fit(cls, df: DataFrame, y: str, columns: Sequence[str], intercept: bool = True, conflevel: float = 0.95) -> OLS:
        return cls.of_moments(moments(df, [*columns, y]), y, list(columns), intercept, conflevel)

    @classmethod
    def of_moments(cls, m: Moments, y: str, columns: list[str], intercept: bool = True, conflevel: float = 0.95) -> OLS:
        """Least squares about the means (or zero without an intercept), whose rank is that of the centred columns."""
        n, k = m.n, len(columns)
        a, mean = (m.centred, m.mean) if intercept else (m.raw[2], np.zeros(k + 1))
        xx, xy, yy = a[:-1, :-1], a[:-1, -1], float(a[-1, -1])
        p = k + intercept
        if n < p:
            raise ValueError(f"{n} complete rows are too few for {p} parameters")
        scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
        correlation = xx / np.outer(scale, scale)
        if k and np.linalg.matrix_rank(correlation, tol=1e-10) < k:
            raise ValueError("the columns are linearly dependent")
        inverse = np.linalg.inv(correlation) / np.outer(scale, scale) if k else np.zeros((0, 0))
        slopes = inverse @ xy
        slopes += inverse @ (xy - xx @ slopes)
        rss = max(0.0, float(yy - 2 * slopes @ xy + slopes @ xx @ slopes))
        dof, beta, whole = n - p, slopes, inverse
        if intercept:
            about = mean[:-1]
            beta = np.append(mean[-1] - about @ slopes, slopes)
            whole = np.zeros((p, p))
            whole[0, 0], whole[0, 1:], whole[1:, 0], whole[1:, 1:] = 1 / n + about @ inverse @ about, -inverse @ about, -inverse @ about, inverse
        return cls(y, columns, [*(["(Intercept)"] * intercept), *columns], beta, whole * (rss / dof if dof else math.nan), n, dof, rss, yy, conflevel, {}, mean, inverse)

    @property
    def intercept(self) -> bool:
        return len(self.names) > len(self.columns)

    def summary(self) -> dict:
        se = np.sqrt(np.diag(self.covariance))
        t = self.beta / se
        c = D.t_ppf(0.5 + self.conflevel / 2, self.dof) if self.dof > 0 else math.nan
        k = len(self.columns)
        r2 = 1 - self.rss / self.tss if self.tss > 0 else math.nan
        f = (self.tss - self.rss) / k / (self.rss / self.dof) if k and self.dof and self.rss > 0 else math.nan
        return {
            "names": self.names,
            "coefficients": self.beta.tolist(),
            "standard_errors": se.tolist(),
            "t_values": t.tolist(),
            "p_values": [D.t_two_sided(x, self.dof) for x in t],
            "conf_intervals": [(b - c * s, b + c * s) for b, s in zip(self.beta, se, strict=True)],
            "r2": r2,
            "adjusted_r2": 1 - (1 - r2) * (self.n - self.intercept) / self.dof if self.dof else math.nan,
            "standard_error": math.sqrt(self.rss / self.dof) if self.dof else math.nan,
            "f_statistic": f,
            "f_p_value": D.f_tail(f, k, self.dof) if f == f else math.nan,
            "n": self.n,
            "dof": self.dof,
        }

    def _about(self) -> list[Column]:
        return [F.col(c).cast("double") - float(m) for c, m in zip(self.columns, self.mean, strict=False)]

    def predicted(self) -> Column:
        out = F.lit(float(self.mean[-1]))
        for x, b in zip(self._about(), self.beta[self.intercept :], strict=True):
            out = out + x * float(b)
        return out

    def predict(self, df: DataFrame, name: str = "y_hat") -> DataFrame:
        return df.withColumn(name, self.predicted())

    def leverage(self) -> Column:
        """x' (X'X)^-1 x, about the means."""
        x = self._about()
        out = F.lit(1.0 / self.n if self.intercept else 0.0)
        for i in range(len(x)):
            for j in range(len(x)):
                out = out + x[i] * x[j] * float(self.inverse[i, j])
        return out

    def prediction_interval(self, df: DataFrame, conflevel: float | None = None) -> DataFrame:
        s2 = self.rss / self.dof
        half = float(D.t_ppf(0.5 + (conflevel or self.conflevel) / 2, self.dof)) * F.sqrt(F.lit(s2) * (1 + self.leverage()))
        return self.predict(df).withColumn("pi_low", F.col("y_hat") - half).withColumn("pi_high", F.col("y_hat") + half)

    def residuals(self, df: DataFrame) -> DataFrame:
        """y_hat, residual, leverage, studentised residual and Cook's distance of each row."""
        s2, p = self.rss / self.dof, len(self.beta)
        out = self.predict(df).withColumn("residual", F.col(self.y) - F.col("y_hat")).withColumn("leverage", self.leverage())
        out = out.withColumn("studentised", F.col("residual") / F.sqrt(s2 * (1 - F.col("leverage"))))
        return out.withColumn("cooks_distance", F.col("studentised") ** 2 * F.col("leverage") / (1 - F.col("leverage")) / p)


def robust_regression(df: DataFrame, x: str, y: str, by: Sequence[str] = (), conflevel: float = 0.95) -> DataFrame:
    """Siegel's line of each group with its standard errors, R2 (explained over explained and residual) and slope interval."""
    kinds = dict(df.dtypes)
    names = ["n", "intercept", "slope", "se_intercept", "se_slope", "r2", "standard_error", "slope_low", "slope_high"]

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        a, b = f["_x"].to_numpy(float), f["_y"].to_numpy(float)
        n = len(a)
        m = repeated_median_slope_of(a, b)
        c = float(np.median(b - m * a)) if n else math.nan
        fit, spread = c + m * a, ((a - a.mean()) ** 2).sum()
        rss, reg = ((b - fit) ** 2).sum(), ((fit - b.mean()) ** 2).sum()
        s = math.sqrt(rss / (n - 2)) if n > 2 else math.nan
        se = s / math.sqrt(spread) if spread > 0 else math.nan
        half = D.t_ppf(0.5 + conflevel / 2, n - 2) * se if n > 2 else math.nan
        return pd.DataFrame([(*(key if by else ()), n, c, m, s * math.sqrt(1 / n + a.mean() ** 2 / spread) if spread > 0 else math.nan, se, reg / (reg + rss) if reg + rss > 0 else math.nan, s, m - half, m + half)], columns=[*by, *names])

    own = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    own = own if by else own.withColumn("_all", F.lit(1))
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "n long", *(f"{c} double" for c in names[1:])])
    return dealt(own, list(by or ["_all"])).groupBy(*(by or ["_all"])).applyInPandas(one, schema)


class UnsafeFormulaError(ValueError):
    """A formula that says more than columns and their products."""


def terms_of(formula: str, allowed: Sequence[str], longest: int = 1000) -> tuple[str, list[tuple[str, ...]]]:
    """The response and the terms of y ~ a + b + a:b + I(a**2), where a*b is a + b + a:b and (a + b)**2 all products of two.

    Only names in `allowed`, +, *, :, I(name ** power) and ** 2 are taken; a
    term is a sorted tuple of names.
    """
    if len(formula) > longest:
        raise UnsafeFormulaError("the formula is too long")
    left, mark, right = formula.partition("~")
    response = left.strip()
    if not mark or response not in allowed:
        raise UnsafeFormulaError(f"no known response: {response!r}")
    try:
        tree = ast.parse(right.replace(":", "@").strip(), mode="eval").body
    except SyntaxError as error:
        raise UnsafeFormulaError(f"not a formula: {right!r}") from error

    def cross(a: list, b: list) -> list:
        return [tuple(sorted({*x, *y})) for x in a for y in b]

    def walk(node: ast.AST) -> list[tuple[str, ...]]:
        if isinstance(node, ast.Name) and node.id in allowed:
            return [(node.id,)]
        if isinstance(node, ast.Constant) and node.value == 1:
            return []
        if isinstance(node, ast.BinOp):
            if isinstance(node.op, ast.Add):
                return walk(node.left) + walk(node.right)
            if isinstance(node.op, ast.MatMult):
                return cross(walk(node.left), walk(node.right))
            if isinstance(node.op, ast.Mult):
                a, b = walk(node.left), walk(node.right)
                return a + b + cross(a, b)
            if isinstance(node.op, ast.Pow) and isinstance(node.right, ast.Constant) and node.right.value in (2, 3):
                base, out = walk(node.left), walk(node.left)
                for _ in range(node.right.value - 1):
                    out = out + cross(out, base)
                return sorted(set(out), key=lambda t: (len(t), t))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "I" and len(node.args) == 1 and not node.keywords:
            power = node.args[0]
            if isinstance(power, ast.BinOp) and isinstance(power.op, ast.Pow) and isinstance(power.left, ast.Name) and power.left.id in allowed and isinstance(power.right, ast.Constant) and power.right.value in (2, 3):
                return [(power.left.id,) * power.right.value]
        raise UnsafeFormulaError(f"not allowed in a formula: {ast.dump(node)[:80]}")

    return response, sorted(set(walk(tree)), key=lambda t: (len(t), t))


def with_terms(df: DataFrame, terms: Sequence[tuple[str, ...]]) -> tuple[DataFrame, list[str]]:
    """df and a column of each term's product."""
    names = [":".join(t) if len(set(t)) == len(t) else f"I({t[0]} ** {len(t)})" for t in terms]
    made = {}
    for t, name in zip(terms, names, strict=True):
        if len(t) > 1:
            column = F.col(t[0])
            for x in t[1:]:
                column = column * F.col(x)
            made[name] = column
    return df.withColumns({f"{n}": c for n, c in made.items()}) if made else df, names


def lm(df: DataFrame, formula: str, alias_threshold: float = 0.995, conflevel: float = 0.95) -> OLS:
    """Least squares by formula; a term that correlates with an earlier one beyond the threshold is dropped and reported."""
    y, terms = terms_of(formula, df.columns)
    out, names = with_terms(df, terms)
    safe = [f"t{i}" for i in range(len(names))]
    out = out.select(*(F.col(f"`{n}`").cast("double").alias(s) for n, s in zip(names, safe, strict=True)), F.col(y).cast("double").alias("y"))
    m = moments(out, [*safe, "y"])
    covariance = m.centred
    sd = np.sqrt(np.maximum(np.diag(covariance), 0))
    kept, aliased = [], {}
    for i, name in enumerate(names):
        twin = next((j for j in kept if sd[i] and sd[j] and abs(covariance[i, j]) > alias_threshold * sd[i] * sd[j]), None)
        if twin is None and sd[i] > 0:
            kept.append(i)
        else:
            aliased[name] = names[twin] if twin is not None else "(Intercept)"
    own = [*kept, len(names)]
    model = OLS.of_moments(Moments(m.n, m.pivot[own], m.sums[own], m.products[np.ix_(own, own)]), y, [names[i] for i in kept], True, conflevel)
    model.aliased = aliased
    return model
