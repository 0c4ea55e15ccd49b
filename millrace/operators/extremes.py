"""Outliers by generalised extreme studentised deviates, of groups of any size.

Each removal takes the value farthest from the mean of what is left, so only
the `most` least and largest values of a group can go.  Those are top-k lists,
which tasks cut before a shuffle; the values between are known by their count,
mean and sum of squares.  Means and spreads after each removal are sums of that
core and of the extremes that are left, built from the inside, so that huge
outliers cost no digits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import distributions as D
from millrace.operators.univariate import esd_of
from millrace.sources.tables import written


def critical(n: int, i: int, alpha: float) -> float:
    """The critical value of the i-th removal (from 1) of n values."""
    m = n - i + 1
    t = D.t_ppf(1 - alpha / (2 * m), m - 2)
    return (m - 1) * t / math.sqrt((m - 2 + t * t) * m)


def removals(low: np.ndarray, high: np.ndarray, n: int, mean: float, ss: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which end each removal takes (True: the high one), and its statistic.

    low, high: the extremes from the outside in; n, mean, ss: the values between them.
    """
    def sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums, and sums of squares, about the core's mean of what is left of x after each number of removals."""
        d = x - mean
        inner = lambda v: np.append(np.cumsum(v[::-1])[::-1], 0.0)
        return inner(d), inner(d * d)

    (low_s, low_q), (high_s, high_q) = sums(low), sums(high)
    sides, statistics = [], []
    l = u = 0
    total = n + len(low) + len(high)
    for i in range(min(most, total - 2)):
        m = total - i
        s, q = low_s[l] + high_s[u], ss + low_q[l] + high_q[u]
        spread = math.sqrt(max(q - s * s / m, 0.0) / (m - 1))
        at = mean + s / m
        a = at - low[l] if l < len(low) else -math.inf
        b = high[u] - at if u < len(high) else -math.inf
        if not spread > 0:
            break
        sides.append(b > a)
        statistics.append(max(a, b) / spread)
        l, u = (l, u + 1) if b > a else (l + 1, u)
    return np.array(sides, bool), np.array(statistics)


def found(statistics: np.ndarray, n: int, alpha: float) -> int:
    """How many removals are outliers: up to the last whose statistic exceeds its critical value; those fall with the removals, so that one tells of all before it that none is below."""
    def last(a: int, b: int) -> int:
        least = critical(n, b, alpha)
        if not statistics[a:b].max() > least:
            return 0
        if statistics[b - 1] > least:
            return b
        return last((a + b) // 2, b) or last(a, (a + b) // 2)

    return last(0, len(statistics)) if len(statistics) else 0


def _extremes(x: DataFrame, by: list[str], most: int) -> DataFrame:
    """The most least and largest rows of each group, with the group's core as columns; x: by, _x, _id."""
    end = lambda name, order: x.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(order, "_id"))).filter(F.col("_rank") <= most).withColumn("_end", F.lit(name)).drop("_rank")
    ends = written(end("low", F.asc("_x")).unionByName(end("high", F.desc("_x"))))
    cuts = ends.groupBy(*by).agg(F.max(F.when(F.col("_end") == "low", F.struct("_x", "_id"))).alias("_low"), F.min(F.when(F.col("_end") == "high", F.struct("_x", (-F.col("_id")).alias("_id")))).alias("_high"))
    # strictly between the two cuts, in the order that chose them; groups may be as many as rows
    inner = (F.struct("_x", "_id") > F.col("_low")) & (F.struct("_x", (-F.col("_id")).alias("_id")) < F.col("_high"))
    core = x.join(cuts, by).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_if(inner).alias("_inner"), F.avg(F.when(inner, F.col("_x"))).alias("_mean"), (F.var_pop(F.when(inner, F.col("_x"))) * F.count_if(inner)).alias("_ss"))
    return ends.join(core, by)


def _ends(f: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The low and high rows from the outside in, no row in both."""
    low = f[f["_end"] == "low"].sort_values(["_x", "_id"])
    high = f[(f["_end"] == "high") & ~f["_id"].isin(low["_id"])].sort_values(["_x", "_id"], ascending=[False, True])
    return low, high


def detect(df: DataFrame, value: str, order: str, by: Sequence[str] = (), most: int = 1, alpha: float = 0.05) -> DataFrame:
    """The removals of each group: position (from 0, in `order`, which tells rows of a group apart), statistic, critical value and whether it is an outlier."""
    own = list(by) or ["_all"]
    x = df.select(*by, F.col(value).cast("double").alias("_x"), F.col(order).alias("_order")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    x = x.dropna(subset=list(by)) if by else x.withColumn("_all", F.lit(1))
    x = written(x.withColumn("_id", F.monotonically_increasing_id()))
    kinds = dict(x.dtypes)

    def all_of(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        """A small group, whose extremes are all it has."""
        f = f.drop_duplicates("_id").sort_values("_id")
        rows = esd_of(f["_x"].to_numpy(), most, alpha)
        out = pd.DataFrame([(int(f["_id"].iloc[p]), *rest) for p, *rest in rows], columns=["_id", "statistic", "critical", "outlier"])
        for name, k in zip(reversed(own), reversed(key), strict=True):
            out.insert(0, name, k)
        return out

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        n, inner = int(f["_n"].iloc[0]), int(f["_inner"].iloc[0])
        if n <= 2 * most:
            return all_of(key, f)
        low, high = _ends(f)
        mean = float(f["_mean"].iloc[0]) if inner else float(low["_x"].iloc[-1])
        sides, statistics = removals(low["_x"].to_numpy(), high["_x"].to_numpy(), inner, mean, float(f["_ss"].iloc[0]) if inner else 0.0, most)
        last = found(statistics, n, alpha)
        ids = np.where(sides, np.append(high["_id"].to_numpy(), -1)[np.minimum(np.cumsum(sides) - 1, len(high))], low["_id"].to_numpy()[np.minimum(np.maximum(np.cumsum(~sides) - 1, 0), len(low) - 1)])
        out = pd.DataFrame({"_id": ids, "statistic": statistics, "critical": [critical(n, i + 1, alpha) for i in range(len(statistics))], "outlier": np.arange(len(statistics)) < last})
        for name, k in zip(reversed(own), reversed(key), strict=True):
            out.insert(0, name, k)
        return out

    names = [f"`{b}` {kinds[b]}" for b in own]
    steps = written(_extremes(x.drop("_order"), own, most).groupBy(*own).applyInPandas(one, ", ".join([*names, "_id long, statistic double, critical double, outlier boolean"])))
    # positions: of each row, how many removed rows come before it in order; counts of those, added up
    removed = steps.join(x.select("_id", "_order"), "_id")
    cuts = removed.groupBy(*own).agg(F.array_sort(F.collect_list("_order")).alias("_cuts"))
    place = x.join(cuts, own).groupBy(*own, F.size(F.filter("_cuts", lambda c: c < F.col("_order"))).alias("_k")).agg(F.count(F.lit(1)).alias("_rows"))
    place = place.withColumn("_upto", F.sum("_rows").over(W.partitionBy(*own).orderBy("_k")))
    ranked = removed.withColumn("_k", F.row_number().over(W.partitionBy(*own).orderBy("_order")) - 1)
    out = ranked.join(place.select(*own, "_k", "_upto"), [*own, "_k"]).withColumn("position", (F.col("_upto") - 1).cast("int"))
    return out.select(*by, "position", "statistic", "critical", "outlier")


#: Error of the ranks that bound the extremes of one group: a share of its rows.
SHARE = 1e-4


def _first_values(counts: DataFrame, most: int, high: bool) -> pd.DataFrame:
    """The values of one end, from the outside in, until they are `most` rows; counts: _x, and n rows that have it."""
    out = counts.orderBy(F.desc("_x") if high else F.asc("_x")).select("_x", "n").limit(most).toPandas()  # `most` rows at the most
    return out[(out["n"].cumsum() - out["n"]) < most]


def _end_values(rows: DataFrame, bounds: dict[str, tuple], most: int) -> dict[str, tuple[pd.DataFrame, pd.DataFrame]]:
    """Of each column the values of its low and its high end and how many rows have each; bounds: about where the ends stop, None if they take all."""
    ends = [(c, high, bounds[c][high]) for c in bounds for high in (False, True)]
    inside = [F.lit(True) if b is None else F.col(c) >= b if high else F.col(c) <= b for c, high, b in ends]
    each = F.array(*(F.when(i & F.col(c).isNotNull(), F.struct(F.lit(k).alias("end"), F.col(c).alias("_x"))) for k, ((c, _, _), i) in enumerate(zip(ends, inside, strict=True))))
    # one pass for all ends, and few rows are left of it
    counts = written(rows.filter(reduce(or_, inside)).select(F.explode(F.filter(each, lambda v: v.isNotNull())).alias("v")).groupBy("v.end", "v._x").agg(F.count(F.lit(1)).alias("n")))
    out = []
    for k, (c, high, b) in enumerate(ends):
        own = _first_values(counts.filter(F.col("end") == k), most, high)
        if b is not None and own["n"].sum() < most:  # the sketch was off
            own = _first_values(rows.select(F.col(c).alias("_x")).dropna().groupBy("_x").agg(F.count(F.lit(1)).alias("n")), most, high)
        out.append(own)
    return {c: (out[2 * i], out[2 * i + 1]) for i, c in enumerate(bounds)}


def cut_offs(df: DataFrame, value: str, most: int, alpha: float = 0.05) -> tuple[float, float]:
    """Values at or below the first, or at or above the second, are outliers; of all rows as one group, `most` outliers at most (more where values tie)."""
    return cut_offs_of(written(df.select(value)), [value], most, alpha)[0]


def cut_offs_of(df: DataFrame, columns: Sequence[str], most: int, alpha: float = 0.05) -> list[tuple[float, float]]:
    """The `cut_offs` of several columns, each pass for all of them; df is read some four times.

    A sketch of ranks bounds the two ends, whose values are counted; no rows are
    sorted by one task, however many there are or tie.
    """
    number = lambda c: F.col(c).cast("double")
    names = {f"c{i}": c for i, c in enumerate(columns)}
    rows = df.select(*(F.when(~F.isnan(number(c)), number(c)).alias(k) for k, c in names.items()))
    n = dict(zip(names, rows.agg(*(F.count(k) for k in names)).first(), strict=True))
    out = {k: (-math.inf, math.inf) for k in names if n[k] < 3}
    for k in names:
        if 3 <= n[k] <= 2 * most:  # the ends meet
            v = rows.select(k).dropna().toPandas()[k].to_numpy()
            beyond = np.isin(np.arange(n[k]), [p for p, *_, o in esd_of(v, most, alpha) if o])
            down, up = v[beyond & (v <= v[~beyond].min())], v[beyond & (v >= v[~beyond].max())]
            out[k] = (float(down.max()) if len(down) else -math.inf, float(up.min()) if len(up) else math.inf)
    large = [k for k in names if k not in out]
    if large:
        reach = {k: most / n[k] + 2 * SHARE for k in large}
        wide = [k for k in large if reach[k] < 0.5]
        sketched = rows.agg(*(F.percentile_approx(k, F.array(F.lit(reach[k]), F.lit(1 - reach[k])), F.lit(int(1 / SHARE))) for k in wide)).first() if wide else ()
        values = _end_values(rows, {k: (None, None) for k in large} | dict(zip(wide, map(tuple, sketched), strict=True)), most)
        inner = {k: (F.col(k) > float(low["_x"].iloc[-1])) & (F.col(k) < float(high["_x"].iloc[-1])) for k, (low, high) in values.items()}
        sums = rows.agg(*(a for k, (low, high) in values.items() for a in (F.count_if(inner[k]), F.avg(F.when(inner[k], F.col(k))), F.var_pop(F.when(inner[k], F.col(k))), F.count_if(F.col(k) <= float(low["_x"].iloc[-1])), F.count_if(F.col(k) >= float(high["_x"].iloc[-1]))))).first()
        for i, (k, (low, high)) in enumerate(values.items()):
            out[k] = _cuts(low, high, sums[5 * i : 5 * i + 5], n[k], most, alpha)
    return [out[k] for k in names]


def _cuts(low: pd.DataFrame, high: pd.DataFrame, row: Sequence, n: int, most: int, alpha: float) -> tuple[float, float]:
    """Cut-offs from the values of both ends; row: count, mean and variance of what lies between, and rows up to and from the last values of the ends."""
    a, b = float(low["_x"].iloc[-1]), float(high["_x"].iloc[-1])
    least, largest = np.repeat(low["_x"], low["n"]).to_numpy()[:most], np.repeat(high["_x"], high["n"]).to_numpy()[:most]
    count = n - len(least) - len(largest)
    # rows between the two ends, and those that tie with the last of an end and are not in it
    parts = [(row[0], row[1] or 0.0, row[2] or 0.0), (row[3] - len(least), a, 0.0), (row[4] - len(largest), b, 0.0)] if a < b else [(count, a, 0.0)]
    mean = sum(k * m for k, m, _ in parts) / count if count else float(least[-1])
    ss = sum(k * (v + (m - mean) ** 2) for k, m, v in parts) if count else 0.0
    sides, statistics = removals(least, largest, count, mean, ss, most)
    sides = sides[: found(statistics, n, alpha)]
    up, down = int(sides.sum()), int((~sides).sum())
    return float(least[down - 1]) if down else -math.inf, float(largest[up - 1]) if up else math.inf
