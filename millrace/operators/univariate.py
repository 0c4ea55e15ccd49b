"""Univariate statistics by group.

Every function takes a DataFrame, the value column and the grouping columns
(none: one group).  NULL and NaN values are left out; rows whose group is NULL
are dropped.  What aggregates and windows can express runs there; statistics of
all pairs or of repeated removals run in pandas, one group at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import distributions as D

#: Sn's factors for two to nine values.
SN_SMALL = {2: 0.743, 3: 1.851, 4: 0.954, 5: 1.351, 6: 0.993, 7: 1.198, 8: 1.005, 9: 1.131}
MAD_NORMAL = 0.6744897501960817


def present(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The groups and values that count, as x."""
    out = df.select(*by, F.col(value).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    for b in by:
        out = out.filter(F.col(b).isNotNull())
    return out


def quantile(column: str | Column, p: float, exact: bool = True) -> Column:
    """Linear-interpolated quantile; not exact: a sketch of bounded memory, for groups of very many distinct values."""
    return F.percentile(column, F.lit(p)) if exact else F.percentile_approx(column, F.lit(p), F.lit(10_000))


def with_median(df: DataFrame, by: Sequence[str], name: str = "m", of: str = "x", exact: bool = True) -> DataFrame:
    """df and its group's median; the medians are joined back, so no group is one window."""
    own = df.groupBy(*by).agg(quantile(of, 0.5, exact).alias(name))
    return df.join(own, list(by)) if by else df.crossJoin(F.broadcast(own))


def median_absolute_deviation(df: DataFrame, value: str, by: Sequence[str] = (), scale: float = MAD_NORMAL, exact: bool = True) -> DataFrame:
    """mad: the median distance to the median over `scale` (1 for the raw distance)."""
    return with_median(present(df, value, by), by, exact=exact).groupBy(*by).agg((quantile(F.abs(F.col("x") - F.col("m")), 0.5, exact) / scale).alias("mad"))


def summary_stats(df: DataFrame, value: str, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Mean, both standard deviations, their share of the mean, quantiles, range, count, median and scaled MAD, in two passes."""
    x = with_median(present(df, value, by), by, exact=exact)
    q = lambda p: quantile("x", p, exact)
    return x.groupBy(*by).agg(
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std_ddof0"),
        F.stddev_samp("x").alias("std_ddof1"),
        (F.stddev_samp("x") / F.avg("x")).alias("rsd_classical"),
        F.max("m").alias("center"),
        (quantile(F.abs(F.col("x") - F.col("m")), 0.5, exact) / MAD_NORMAL).alias("spread"),
        q(0.05).alias("p05"),
        q(0.25).alias("p25"),
        q(0.75).alias("p75"),
        q(0.95).alias("p95"),
        (q(0.75) - q(0.25)).alias("iqr"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.count("x").alias("n"),
    )


def box_statistics(df: DataFrame, value: str, by: Sequence[str], exact: bool = True) -> DataFrame:
    """Five numbers, fences of 1.5 interquartile ranges, and how many values lie beyond them."""
    x = present(df, value, by)
    if exact:
        box = x.groupBy(*by).agg(F.min("x").alias("low"), F.max("x").alias("high")).join(quantiles(x, by, {"q1": 0.25, "q2": 0.5, "q3": 0.75}), list(by)).select(*by, "low", "q1", "q2", "q3", "high")
    else:
        box = x.groupBy(*by).agg(F.min("x").alias("low"), quantile("x", 0.25, exact).alias("q1"), quantile("x", 0.5, exact).alias("q2"), quantile("x", 0.75, exact).alias("q3"), F.max("x").alias("high"))
    box = box.withColumn("lower_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("upper_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    beyond = (F.col("x") < F.col("lower_fence")) | (F.col("x") > F.col("upper_fence"))
    counts = x.join(box, list(by)).groupBy(*by).agg(F.sum(beyond.cast("long")).alias("n_outliers"))
    return box.join(counts, list(by))


def biweight_midvariance(df: DataFrame, value: str, by: Sequence[str] = (), reach: float = 9.0) -> DataFrame:
    """n sum((x-m)^2 (1-u^2)^4) / sum((1-u^2)(1-5u^2))^2 over |u| <= 1, u = (x-m) / (reach MAD)."""
    x = with_median(present(df, value, by), by)
    x = with_median(x.withColumn("d", F.abs(F.col("x") - F.col("m"))), by, "mad", "d")
    u = (F.col("x") - F.col("m")) / (reach * F.col("mad"))
    inside = F.when(F.col("mad") > 0, F.abs(u) <= 1).otherwise(False)
    top = F.sum(F.when(inside, (F.col("x") - F.col("m")) ** 2 * (1 - u * u) ** 4))
    bottom = F.sum(F.when(inside, (1 - u * u) * (1 - 5 * u * u)))
    return x.groupBy(*by).agg(F.coalesce(F.count("x") * top / (bottom * bottom), F.lit(0.0)).alias("biweight_midvariance"))


def group_moments(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    x = present(df, value, by)
    return x.groupBy(*by).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"))


def t_quantile(df: DataFrame, dof: str, conflevel: float, name: str) -> DataFrame:
    """df and the two-sided t quantile of each row's degrees of freedom; rows are group results, few and small."""
    own = F.pandas_udf(lambda v: v.map(lambda k: D.t_ppf(0.5 + conflevel / 2, float(k)) if k and k > 0 else math.nan), "double")
    return df.withColumn(name, own(F.col(dof)))


def p_value(df: DataFrame, t: str, dof: str, name: str) -> DataFrame:
    own = F.pandas_udf(lambda z, v: pd.Series([D.t_two_sided(a, b) if b and b > 0 and a == a else math.nan for a, b in zip(z, v, strict=True)], dtype=float), "double")
    return df.withColumn(name, own(F.col(t), F.col(dof)))


def ttest_independent(df: DataFrame, value: str, group: str, conflevel: float = 0.995) -> DataFrame:
    """Pooled-variance t tests of all pairs of groups, the difference being B minus A, A before B in order.

    Pairs come from the groups' counts, means and variances, never from rows.
    """
    g = group_moments(df, value, [group])
    a = g.select(*(F.col(c).alias(f"{c}_a") for c in g.columns))
    b = g.select(*(F.col(c).alias(f"{c}_b") for c in g.columns))
    pairs = a.join(b, F.col(f"{group}_a") < F.col(f"{group}_b"))
    dof = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("variance_a") + (F.col("n_b") - 1) * F.col("variance_b")) / dof
    se = F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))
    out = pairs.select(F.col(f"{group}_a").alias("group_a"), F.col(f"{group}_b").alias("group_b"), "n_a", "n_b", "mean_a", "mean_b", (F.col("mean_b") - F.col("mean_a")).alias("difference"), se.alias("standard_error"), dof.alias("dof"))
    out = out.withColumn("t", F.col("difference") / F.col("standard_error"))
    out = p_value(t_quantile(out, "dof", conflevel, "c"), "t", "dof", "p_value")
    return out.withColumn("ci_low", F.col("difference") - F.col("c") * F.col("standard_error")).withColumn("ci_high", F.col("difference") + F.col("c") * F.col("standard_error")).drop("c")


def ttest_paired(df: DataFrame, value: str, group: str, order: Sequence[str], a: object, b: object, conflevel: float = 0.995) -> DataFrame:
    """The paired t test of two groups, their rows paired by position in `order`; the difference is A minus B."""
    own = lambda g, name: df.filter(F.col(group) == F.lit(g)).select(F.row_number().over(W.partitionBy(group).orderBy(*order)).alias("k"), F.col(value).alias(name))
    both = own(a, "a").join(own(b, "b"), "k").select((F.col("a") - F.col("b")).alias("d"))
    out = both.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd")).withColumn("dof", F.col("n") - 1).withColumn("standard_error", F.col("sd") / F.sqrt("n"))
    out = out.withColumn("t", F.col("mean") / F.col("standard_error"))
    out = p_value(t_quantile(out, "dof", conflevel, "c"), "t", "dof", "p_value")
    return out.withColumn("ci_low", F.col("mean") - F.col("c") * F.col("standard_error")).withColumn("ci_high", F.col("mean") + F.col("c") * F.col("standard_error")).drop("c")


def confidence_interval(df: DataFrame, value: str, by: Sequence[str] = (), conflevel: float = 0.95, style: str = "robust", exact: bool = True) -> DataFrame:
    """center -/+ t s / sqrt(n): median and MAD sqrt(pi / 2), or mean and standard deviation."""
    x = with_median(present(df, value, by), by, exact=exact)
    robust = style == "robust"
    out = x.groupBy(*by).agg(
        F.count("x").alias("n"),
        (F.max("m") if robust else F.avg("x")).alias("center"),
        (quantile(F.abs(F.col("x") - F.col("m")), 0.5, exact) / MAD_NORMAL * math.sqrt(math.pi / 2) if robust else F.stddev_samp("x")).alias("spread"),
    )
    out = t_quantile(out.withColumn("dof", F.col("n") - 1), "dof", conflevel, "c")
    half = F.col("c") * F.col("spread") / F.sqrt("n")
    return out.withColumn("ci_low", F.col("center") - half).withColumn("ci_high", F.col("center") + half).drop("c", "dof")


def holm_bonferroni(df: DataFrame, p: str, by: Sequence[str] = (), name: str = "p_holm") -> DataFrame:
    """Step-down adjusted p values: the running maximum of (m - rank + 1) p, at most 1."""
    order = W.partitionBy(*by).orderBy(p)
    m = F.count("*").over(W.partitionBy(*by))
    raw = df.withColumn("_raw", (m - F.row_number().over(order) + 1) * F.col(p))
    return raw.withColumn(name, F.least(F.lit(1.0), F.max("_raw").over(order.rowsBetween(W.unboundedPreceding, 0)))).drop("_raw")


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = (), name: str = "p_bh") -> DataFrame:
    """Step-up adjusted p values: the running minimum of m p / rank from the largest, at most 1."""
    m = F.count("*").over(W.partitionBy(*by))
    raw = df.withColumn("_raw", m * F.col(p) / F.row_number().over(W.partitionBy(*by).orderBy(p)))
    down = W.partitionBy(*by).orderBy(F.desc(p)).rangeBetween(W.unboundedPreceding, 0)  # equal p values have equal results
    return raw.withColumn(name, F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_raw")


def variance_decomposition(df: DataFrame, value: str, repeat: str, by: Sequence[str] = ()) -> DataFrame:
    """Within and between mean squares of repeats, their degrees of freedom, and the between component."""
    g = present(df, value, [*by, repeat]).groupBy(*by, repeat).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("v"), F.sum("x").alias("sum"))
    out = g.groupBy(*by).agg(
        F.count("*").alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("within_ss"),
        (F.sum(F.col("sum") * F.col("mean")) - F.sum("sum") * F.sum("sum") / F.sum("n")).alias("between_ss"),
    )
    out = out.withColumn("within_dof", F.col("n") - F.col("groups")).withColumn("between_dof", F.col("groups") - 1)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    out = out.withColumn("within_ms", ratio("within_ss", "within_dof")).withColumn("between_ms", ratio("between_ss", "between_dof"))
    n0 = (F.col("n") - F.col("squares") / F.col("n")) / F.col("between_dof")
    component = F.when(F.col("between_dof") > 0, F.greatest(F.lit(0.0), (F.col("between_ms") - F.col("within_ms")) / n0))
    return out.withColumn("between_variance", component).withColumn("within_variance", F.col("within_ms")).select(*by, "within_ms", "between_ms", "within_dof", "between_dof", "within_variance", "between_variance")


def calculate_cpk(df: DataFrame, value: str, lower: float | None, upper: float | None, by: Sequence[str] = (), trim_percentile: float = 2.5) -> DataFrame:
    """Cpk; NaN leaves a side out, None takes the trimming percentile as its limit.

    With trimming the centre is the median and the spread Sn, of the values
    within the percentiles; without it mean and standard deviation.
    """
    x = present(df, value, by)
    robust = trim_percentile > 0
    if robust or lower is None or upper is None:
        p = trim_percentile / 100
        limits = x.groupBy(*by).agg(quantile("x", p).alias("_low"), quantile("x", 1 - p).alias("_high"))
        x = x.join(limits, list(by)) if by else x.crossJoin(F.broadcast(limits))
    side = lambda given, own: F.col(own) if given is None else F.lit(float(given))
    x = x.withColumn("_lsl", side(lower, "_low")).withColumn("_usl", side(upper, "_high"))
    if robust:
        x = x.filter((F.col("x") >= F.col("_low")) & (F.col("x") <= F.col("_high")))
        spread = sn(x.select(*by, "x"), "x", by).withColumnRenamed("sn", "_spread")
        own = x.groupBy(*by).agg(F.median("x").alias("_center"), F.first("_lsl").alias("_lsl"), F.first("_usl").alias("_usl"))
        own = own.join(spread, list(by)) if by else own.crossJoin(F.broadcast(spread))
    else:
        own = x.groupBy(*by).agg(F.avg("x").alias("_center"), F.stddev_samp("x").alias("_spread"), F.first("_lsl").alias("_lsl"), F.first("_usl").alias("_usl"))
    have = lambda c: F.when(~F.isnan(c), F.col(c))
    up, low = (have("_usl") - F.col("_center")) / (3 * F.col("_spread")), (F.col("_center") - have("_lsl")) / (3 * F.col("_spread"))
    cpk = F.when(F.col("_spread") > 0, F.least(F.coalesce(up, low), F.coalesce(low, up)))
    return own.select(*by, F.col("_center").alias("center"), F.col("_spread").alias("spread"), cpk.alias("cpk"))


def sn_of(x: np.ndarray) -> float:
    """Rousseeuw and Croux's Sn in n log n: each value's distance to its (n // 2)-th nearest, then the low median."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 2:
        return math.nan if n == 0 else 0.0
    k = n // 2
    i = np.arange(n)
    low, high = np.maximum(0, i - k), np.minimum(i, n - 1 - k)
    first, last = low.copy(), high.copy()
    while (first < last).any():  # the window [l, l + k] whose two ends are most alike
        mid = (first + last) // 2
        left = x[mid + k] - x[i] < x[i] - x[mid]
        first, last = np.where((first < last) & left, mid + 1, first), np.where((first < last) & ~left, mid, last)
    reach = lambda at: np.maximum(x[i] - x[at], x[at + k] - x[i])
    distance = np.minimum(reach(first), reach(np.maximum(first - 1, low)))
    middle = np.sort(distance)[(n + 1) // 2 - 1]
    factor = SN_SMALL.get(n, n / (n - 0.9) if n % 2 else 1.0)
    return 1.1926 * factor * float(middle)


def by_group(x: DataFrame, by: Sequence[str], schema: str, run) -> DataFrame:
    """run(array of x) -> rows, of each group; without groups all values are one task's."""
    names = [f"`{b}` {dict(x.dtypes)[b]}" for b in by]
    keyed = x if by else x.withColumn("_all", F.lit(1))

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        rows = run(f["x"].to_numpy())
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
        for name, k in zip(reversed(by), reversed(key), strict=False):
            out.insert(0, name, k)
        return out

    return keyed.groupBy(*(by or ["_all"])).applyInPandas(one, ", ".join([*names, schema]))


def sn(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return by_group(present(df, value, by), by, "sn double", lambda x: [(sn_of(x),)])


def esd_of(x: np.ndarray, most: int, alpha: float = 0.05, robust: bool = False) -> list[tuple]:
    """Generalised extreme studentised deviates: of each removal its position, statistic and critical value, and whether it is an outlier."""
    left, out = np.arange(len(x)), []
    for i in range(1, min(most, len(x) - 2) + 1):
        own = x[left]
        center = np.median(own) if robust else own.mean()
        spread = np.median(np.abs(own - center)) / MAD_NORMAL if robust else own.std(ddof=1)
        if not spread > 0:
            break
        far = int(np.abs(own - center).argmax())
        m = len(x) - i + 1
        t = D.t_ppf(1 - alpha / (2 * m), m - 2)
        out.append([int(left[far]), float(abs(own[far] - center) / spread), (m - 1) * t / math.sqrt((m - 2 + t * t) * m)])
        left = np.delete(left, far)
    last = max((k for k, (_, r, c) in enumerate(out) if r > c), default=-1)
    return [(p, r, c, k <= last) for k, (p, r, c) in enumerate(out)]


def detect_outliers_esd(df: DataFrame, value: str, order: str, by: Sequence[str] = (), most: int = 1, alpha: float = 0.05, robust: bool = False) -> DataFrame:
    """The removals of each group; position counts from 0 in `order`, which tells the rows of a group apart.

    Groups may be of any size; only the robust form, by medians of what is left, holds a group in one task.
    """
    if not robust:
        from millrace.operators.extremes import detect

        return detect(df, value, order, by, most, alpha)
    x = df.select(*by, F.col(value).cast("double").alias("x"), F.col(order).alias("_order")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    names = [f"`{b}` {dict(x.dtypes)[b]}" for b in by]
    keyed = x if by else x.withColumn("_all", F.lit(1))

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        rows = esd_of(f.sort_values("_order")["x"].to_numpy(), most, alpha, robust)
        out = pd.DataFrame(rows, columns=["position", "statistic", "critical", "outlier"])
        for name, k in zip(reversed(by), reversed(key), strict=False):
            out.insert(0, name, k)
        return out

    return keyed.groupBy(*(by or ["_all"])).applyInPandas(one, ", ".join([*names, "position int, statistic double, critical double, outlier boolean"]))


def test_normality(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return by_group(present(df, value, by), by, "w double, p_value double", lambda x: [D.shapiro(x)])


def tietjen_moore(df: DataFrame, value: str, k: int, by: Sequence[str] = (), two_sided: bool = True, alpha: float = 0.05, simulations: int = 10_000, seed: int = 0) -> DataFrame:
    """The share of variation that stays without the k most extreme values, against simulated normals."""

    def statistic(x: np.ndarray) -> np.ndarray:
        x = np.sort(x, axis=-1)
        if two_sided:
            x = np.take_along_axis(x, np.argsort(np.abs(x - x.mean(axis=-1, keepdims=True)), axis=-1, kind="stable"), axis=-1)
        kept = x[..., : x.shape[-1] - k]
        return ((kept - kept.mean(axis=-1, keepdims=True)) ** 2).sum(axis=-1) / ((x - x.mean(axis=-1, keepdims=True)) ** 2).sum(axis=-1)

    def run(x: np.ndarray) -> list[tuple]:
        draws = np.random.default_rng(seed)
        null = np.concatenate([statistic(draws.normal(size=(500, len(x)))) for _ in range(-(-simulations // 500))])
        own, critical = float(statistic(x)), float(np.quantile(null, alpha))
        return [(own, critical, float((null <= own).mean()), own < critical)]

    return by_group(present(df, value, by), by, "statistic double, critical double, p_value double, outliers boolean", run)


#: Rows of one value that a task numbers at once.
TIES = 1 << 16


def ranks(x: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each distinct value of each group, how many rows have it (`same`) and how many are below it (`before`); x: by and "x".

    Values are counted first, so a common one is one row; distinct values are
    sorted in ranges, and a range follows the sizes of those before it, of which
    there are as many as partitions and groups.
    """
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = x.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("same"))
    inner = counted.repartitionByRange(parts, *by, "x").withColumn("_part", F.spark_partition_id())
    sizes = inner.groupBy(*by, "_part").agg(F.sum("same").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    own = inner.withColumn("_own", F.coalesce(F.sum("same").over(W.partitionBy(*by, "_part").orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return own.join(before, [*by, "_part"]).withColumn("before", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def quantiles(x: DataFrame, by: Sequence[str], at: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles of each group by name, from counts below each distinct value: exact, and no task holds the values of one huge group; x: by (one at least) and "x"."""
    n = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = ranks(x, by).join(n, list(by))
    made = {}
    for name, p in at.items():
        place = (F.col("_n") - 1) * p
        # the values of the rows, from 0, on both sides of the place; each lies in one run of equal values
        for end, k in (("low", F.floor(place)), ("high", F.ceil(place))):
            made[f"_{name}_{end}"] = F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("same")), F.col("x")))
    out = rows.groupBy(*by, "_n").agg(*(c.alias(m) for m, c in made.items()))
    share = lambda p: (F.col("_n") - 1) * p - F.floor((F.col("_n") - 1) * p)
    between = lambda name, p: F.when(F.col(f"_{name}_low") == F.col(f"_{name}_high"), F.col(f"_{name}_low")).otherwise((1 - share(p)) * F.col(f"_{name}_low") + share(p) * F.col(f"_{name}_high"))
    return out.select(*by, *(between(name, p).alias(name) for name, p in at.items()))


def ranked(x: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every row of x (by and "x") with the rank of its value in its group (`rank`, from 1), however large a group is; rows of one value have ranks one after another, and are dealt to tasks in runs of TIES."""
    runs = ranks(x, by).withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("same") - 1) / TIES))))
    dealt = runs.repartition(*(F.col(b) for b in by), "x", "_run")
    last = F.least(F.col("same"), (F.col("_run") + 1) * TIES)
    return dealt.withColumn("rank", F.explode(F.sequence(F.col("before") + F.col("_run") * TIES + 1, F.col("before") + last))).select(*by, "x", "rank")


def distribution_fit(df: DataFrame, value: str, by: Sequence[str] = (), distribution: str = "norm") -> DataFrame:
    """Maximum likelihood location and scale of a normal (norm) or exponential distribution, with a Kolmogorov-Smirnov test: an aggregate, and ranks over sorted ranges."""
    x = present(df, value, by)
    if distribution == "norm":
        loc, scale = F.avg("x"), F.stddev_pop("x")
        cdf = F.pandas_udf(lambda z: pd.Series(np.fromiter(map(math.erfc, -z.to_numpy(float) / math.sqrt(2)), float, len(z)) / 2), "double")  # of distinct values only
    else:
        loc, scale = F.min("x"), F.avg("x") - F.min("x")
        cdf = lambda z: 1 - F.exp(-z)
    fit = x.groupBy(*by).agg(loc.alias("location"), scale.alias("scale"), F.count("x").alias("_n"))
    rows = ranks(x, by)
    rows = rows.join(fit, list(by)) if by else rows.crossJoin(F.broadcast(fit))
    rows = rows.withColumn("_f", cdf((F.col("x") - F.col("location")) / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)))
    gap = F.greatest((F.col("before") + F.col("same")) / F.col("_n") - F.col("_f"), F.col("_f") - F.col("before") / F.col("_n"))
    out = rows.groupBy(*by, "location", "scale", "_n").agg(F.max(gap).alias("distance"))
    tail = F.pandas_udf(lambda d, n: pd.Series([D.kolmogorov_tail(float(a), int(b)) for a, b in zip(d, n, strict=True)], dtype=float), "double")
    return out.select(*by, "location", "scale", "distance", tail("distance", "_n").alias("p_value"))
