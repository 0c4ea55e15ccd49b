"""Comparisons of groups with a control, tests of panels against covariates, and cell-wise summaries used with them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import distributions as D


def dunnett(df: DataFrame, value: str, group: str, control: object, alpha: float = 0.05) -> DataFrame:
    """Each group against the control, two-sided, from the groups' counts, means and variances."""
    g = df.select(F.col(group).alias("g"), F.col(value).alias("x")).dropna().groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v"))
    pool = g.agg((F.sum("n") - F.count("*")).alias("dof"), (F.sum((F.col("n") - 1) * F.col("v")) / (F.sum("n") - F.count("*"))).alias("mse"), (F.count("*") - 1).alias("k"))
    own = g.filter(F.col("g") == F.lit(control)).select(F.col("n").alias("n0"), F.col("mean").alias("mean0"))
    out = g.filter(F.col("g") != F.lit(control)).crossJoin(F.broadcast(own)).crossJoin(F.broadcast(pool))
    out = out.withColumn("difference", F.col("mean") - F.col("mean0")).withColumn("t", F.try_divide(F.col("difference"), F.sqrt(F.col("mse") * (1 / F.col("n") + 1 / F.col("n0")))))

    @F.pandas_udf("double")
    def p(t: pd.Series, k: pd.Series, v: pd.Series, n: pd.Series, n0: pd.Series) -> pd.Series:
        return pd.Series([1 - D.dunnett_cdf(abs(a), int(b), float(c), d / (d + e)) if a == a and c > 0 else math.nan for a, b, c, d, e in zip(t, k, v, n, n0, strict=True)], dtype=float)

    return out.withColumn("p_value", p("t", "k", "dof", "n", "n0")).select(F.col("g").alias(group), "n", "difference", "t", "p_value", (F.col("p_value") < alpha).alias("significant"))


def relate(products: DataFrame, attributes: Sequence[str], covariates: Sequence[str]) -> DataFrame:
    """Pearson's correlation of each attribute with each covariate over products, p value, and the same adjusted by Benjamini and Hochberg; one aggregate."""
    from millrace.operators.univariate import benjamini_hochberg

    pairs = [(a, c) for a in attributes for c in covariates]
    row = products.agg(*(F.corr(a, c) for a, c in pairs), *(F.count(F.when(F.col(a).isNotNull() & F.col(c).isNotNull(), 1)) for a, c in pairs)).first()
    out = []
    for i, (a, c) in enumerate(pairs):
        r, n = row[i], row[len(pairs) + i]
        ok = r is not None and n > 2 and abs(r) < 1
        out.append((a, c, r, n, D.t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2) if ok else 0.0 if r is not None and abs(r) >= 1 else None))
    table = products.sparkSession.createDataFrame(out, "attribute string, covariate string, r double, n long, p_value double")
    return benjamini_hochberg(table.filter("p_value IS NOT NULL"), "p_value")


def factorial_anova(df: DataFrame, value: str, a: str, b: str) -> list[dict]:
    """Two factors and their interaction in a balanced table, from cell means; an unbalanced table gets sums of squares of unweighted means."""
    cell = df.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(value).alias("x")).dropna().groupBy("a", "b").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v"))
    rows = cell.toPandas()  # one row a cell
    h = len(rows) / (1 / rows["n"]).sum()
    table = rows.pivot(index="a", columns="b", values="m").dropna(axis=0)
    grand = table.to_numpy().mean()
    by_a, by_b = table.mean(axis=1), table.mean(axis=0)
    i, j = table.shape
    inner = table.to_numpy() - by_a.to_numpy()[:, None] - by_b.to_numpy()[None, :] + grand
    within, dof = float(((rows["n"] - 1) * rows["v"]).sum()), int(rows["n"].sum() - len(rows))
    ms = within / dof if dof else math.nan
    out = []
    for name, ss, k in ((a, h * j * ((by_a - grand) ** 2).sum(), i - 1), (b, h * i * ((by_b - grand) ** 2).sum(), j - 1), (f"{a}:{b}", h * (inner**2).sum(), (i - 1) * (j - 1))):
        f = ss / k / ms if k and ms and ms > 0 else math.nan
        out.append({"term": name, "sum_sq": float(ss), "df": k, "f": f, "p_value": D.f_tail(f, k, dof) if f == f else math.nan})
    return [*out, {"term": "Residual", "sum_sq": within, "df": dof, "f": math.nan, "p_value": math.nan}]
