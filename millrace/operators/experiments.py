"""Analysis of experiments by linear models: any number of rows, a handful of terms.

One pass gives the cross products of all candidate terms; analysis of variance,
model selection and transformations are small solves on them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import distributions as D
from millrace.operators.linear import moments, terms_of, with_terms


@dataclass
class Products:
    """Moments of terms and y: all that a least-squares fit of any subset of terms, with an intercept, needs."""

    names: list[str]
    members: list[tuple[str, ...]]
    n: int
    centred: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, formula: str) -> Products:
        y, terms = terms_of(formula, df.columns)
        out, names = with_terms(df, terms)
        safe = [f"t{i}" for i in range(len(names))]
        out = out.select(*(F.col(f"`{n}`").cast("double").alias(s) for n, s in zip(names, safe, strict=True)), F.col(y).cast("double").alias("y"))
        m = moments(out, [*safe, "y"])
        return cls(names, terms, m.n, m.centred)

    def rss(self, keep: Sequence[int]) -> float:
        keep = list(keep)
        xx, xy = self.centred[np.ix_(keep, keep)], self.centred[keep, -1]
        scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
        return max(0.0, float(self.total - (xy / scale) @ np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale, rcond=1e-12)[0])) if keep else self.total

    @property
    def total(self) -> float:
        return float(self.centred[-1, -1])


def anova(df: DataFrame, formula: str) -> list[dict]:
    """Type II: each term against the model of all terms that do not contain it."""
    p = Products.of(df, formula)
    every = list(range(len(p.names)))
    rss = p.rss(every)
    dof = p.n - len(every) - 1
    out = []
    for i in every:
        others = [j for j in every if j != i and not (set(p.members[i]) <= set(p.members[j]) and len(p.members[j]) > len(p.members[i]))]
        ss = max(0.0, p.rss(others) - p.rss([*others, i]))
        f = ss / (rss / dof) if dof > 0 and rss > 0 else math.nan
        out.append({"term": p.names[i], "sum_sq": ss, "df": 1, "f": f, "p_value": D.f_tail(f, 1, dof) if f == f else math.nan})
    return [*out, {"term": "Residual", "sum_sq": rss, "df": dof, "f": math.nan, "p_value": math.nan}]


def select_model(df: DataFrame, formula: str, criterion: str = "aic", forward: bool = False) -> list[str]:
    """Backward or forward steps while the criterion improves; a term stays while a product of it does."""
    p = Products.of(df, formula)
    price = 2.0 if criterion == "aic" else math.log(p.n)
    score = lambda keep: p.n * math.log(max(p.rss(keep), 1e-300) / p.n) + price * (len(keep) + 1)
    keep = [] if forward else list(range(len(p.names)))
    best = score(keep)
    while True:
        if forward:
            steps = [[*keep, i] for i in range(len(p.names)) if i not in keep]
        else:
            steps = [[j for j in keep if j != i] for i in keep if not any(set(p.members[i]) < set(p.members[j]) for j in keep)]
        scored = sorted((score(s), s) for s in steps)
        if not scored or scored[0][0] >= best - 1e-12:
            return [p.names[i] for i in sorted(keep)]
        best, keep = scored[0]


def box_cox(df: DataFrame, y: str, lambdas: Sequence[float] | None = None) -> dict:
    """The power of y with the largest normal likelihood, over a grid, in one aggregate."""
    grid = [round(float(x), 2) for x in (lambdas if lambdas is not None else np.linspace(-2, 2, 41))]
    rows = df.select(F.col(y).cast("double").alias("y")).filter("y > 0")
    moved = lambda g: F.log("y") if g == 0 else (F.pow("y", F.lit(float(g))) - 1) / float(g)
    row = rows.agg(F.count("y"), F.sum(F.log("y")), *(F.var_pop(moved(g)) for g in grid)).first()
    n, logs = row[0], row[1]
    likelihood = [-n / 2 * math.log(v) + (g - 1) * logs if v and v > 0 else -math.inf for g, v in zip(grid, row[2:], strict=True)]
    return {"lambda": grid[int(np.argmax(likelihood))], "log_likelihood": float(max(likelihood)), "n": n}


def curvature(df: DataFrame, y: str, factors: Sequence[str]) -> dict:
    """Centre points against factorial points, with the centre points' own spread."""
    middle = F.lit(True)
    for f in factors:
        middle = middle & (F.col(f) == 0)
    row = df.agg(F.avg(F.when(middle, F.col(y))), F.avg(F.when(~middle, F.col(y))), F.count(F.when(middle, F.col(y))), F.count(F.when(~middle, F.col(y))), F.var_samp(F.when(middle, F.col(y)))).first()
    center, cube, nc, nf, v = row
    if not nc or nc < 2 or not nf or not v:
        return {"difference": None if center is None or cube is None else cube - center, "f": math.nan, "p_value": math.nan}
    f = nc * nf * (cube - center) ** 2 / (nc + nf) / v
    return {"difference": cube - center, "f": f, "p_value": D.f_tail(f, 1, nc - 1)}


def residual_tests(rows: DataFrame, residual: str, order: str, fitted: str) -> dict:
    """Durbin and Watson's statistic over sorted ranges of the order, and Breusch and Pagan's by one aggregate."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        steps = squares = 0.0
        for b in batches:
            e = b.column(0).to_numpy(zero_copy_only=False)
            e = e[~np.isnan(e)]
            if not len(e):
                continue
            steps += float((np.diff(e) ** 2).sum()) + (0.0 if last is None else float((e[0] - last) ** 2))
            squares += float((e**2).sum())
            first, last = float(e[0]) if first is None else first, float(e[-1])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (TaskContext.get().partitionId(), first, last, steps, squares)], ["part", "first", "last", "steps", "squares"])

    dealt = rows.select(F.col(residual).cast("double").alias("e"), order).repartitionByRange(parts, order).sortWithinPartitions(order).select("e")
    # one row a range
    ranges = sorted(tuple(r) for r in dealt.mapInArrow(run, "part long, first double, last double, steps double, squares double").collect())
    squares = sum(r[4] for r in ranges)
    steps = sum(r[3] for r in ranges) + sum((b[1] - a[2]) ** 2 for a, b in zip(ranges, ranges[1:], strict=False))
    n, r2 = rows.agg(F.count(residual), F.corr(F.col(residual) ** 2, F.col(fitted))).first()
    lm = n * (r2 or 0.0) ** 2
    return {"durbin_watson": steps / squares if squares > 0 else math.nan, "breusch_pagan": lm, "breusch_pagan_p": 1 - D.chi2_cdf(lm, 1)}
