"""Features of batch trajectories: one row of numbers for each batch (and phase).

A trajectory is a long table: batch, an age that orders its rows, and one column
for each tag.  Null groups are dropped, as are null values where a feature says
so.  Everything that an aggregate can say is computed in one pass; what needs
the neighbour in age takes one window over the batch.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.robust import elbow_of, repeated_median_slope_of
from millrace.operators.univariate import MAD_NORMAL
from millrace.sources.tables import dealt

SIMPLE = ("mean", "median", "std", "iqr", "sum", "min", "max", "count", "agemin", "agemax", "last")


def _aggregates(tag: str, age: str | None, which: Sequence[str]) -> list:
    x = F.col(tag)
    known = F.count(x)
    made = {
        "mean": lambda: F.avg(x),
        "median": lambda: F.median(x),
        "std": lambda: F.stddev_samp(x),
        "iqr": lambda: F.when(known == F.count("*"), F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))),
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "count": lambda: known,
        # the first age of the extreme; the last known value by age
        "agemin": lambda: F.min(F.when(x.isNotNull(), F.struct(x, F.col(age).alias("age"))))["age"],
        "agemax": lambda: F.min(F.when(x.isNotNull(), F.struct((-x).alias("x"), F.col(age).alias("age"))))["age"],
        "last": lambda: F.max(F.when(x.isNotNull(), F.struct(F.col(age).alias("age"), x.alias("x"))))["x"],
    }
    return [made[w]().alias(f"{tag}_{w}") for w in which]


def features(df: DataFrame, tags: Sequence[str], by: Sequence[str], age: str | None = None, which: Sequence[str] = SIMPLE) -> DataFrame:
    """The named features of each tag, in one aggregate; `iqr` is null where a value is missing."""
    which = [w for w in which if age is not None or w not in ("agemin", "agemax", "last")]
    df = df.dropna(subset=list(by))
    return df.groupBy(*by).agg(*(c for t in tags for c in _aggregates(t, age, which)))


def robust_mad(df: DataFrame, tag: str, by: Sequence[str]) -> DataFrame:
    own = df.select(*by, F.col(tag).alias("x")).dropna()
    middle = own.groupBy(*by).agg(F.median("x").alias("m"))
    return own.join(middle, list(by)).groupBy(*by).agg((F.median(F.abs(F.col("x") - F.col("m"))) / MAD_NORMAL).alias(f"{tag}_robust_mad"))


def area(df: DataFrame, tag: str, age: str, by: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The trapezoid area over age; a missing value makes it null."""
    w = W.partitionBy(*by).orderBy(age, *order)
    x, t = F.col(tag), F.col(age)
    step = df.dropna(subset=list(by)).select(*by, x, ((x + F.lag(x).over(w)) / 2 * (t - F.lag(t).over(w))).alias("a"), F.row_number().over(w).alias("k"))
    whole = F.count(tag) == F.count("*")
    return step.groupBy(*by).agg(F.when(whole, F.coalesce(F.sum("a"), F.lit(0.0))).alias(f"{tag}_area"))


def crossings(df: DataFrame, tag: str, age: str, by: Sequence[str], threshold: float = 0.0, direction: str = "cross", order: Sequence[str] = ()) -> DataFrame:
    """Every age at which the tag crosses the threshold, interpolated; above is strictly greater."""
    w = W.partitionBy(*by).orderBy(age, *order)
    x, t = F.col(tag), F.col(age)
    step = df.dropna(subset=[*by, tag]).select(*by, x.alias("x"), t.alias("t"), F.lag(x).over(w).alias("x0"), F.lag(t).over(w).alias("t0"))
    rising, falling = (F.col("x0") <= threshold) & (F.col("x") > threshold), (F.col("x0") > threshold) & (F.col("x") <= threshold)
    wanted = {"rising": rising, "falling": falling, "cross": rising | falling}[direction]
    at = F.col("t0") + (threshold - F.col("x0")) / (F.col("x") - F.col("x0")) * (F.col("t") - F.col("t0"))
    return step.filter(wanted).select(*by, at.alias("at"), F.when(rising, "rising").otherwise("falling").alias("direction"))


def first_crossing(df: DataFrame, tag: str, age: str, by: Sequence[str], threshold: float = 0.0, direction: str = "cross", order: Sequence[str] = ()) -> DataFrame:
    found = crossings(df, tag, age, by, threshold, direction, order).groupBy(*by).agg(F.min("at").alias(f"{tag}_crossing"))
    return df.select(*by).dropna().distinct().join(found, list(by), "left")


def _of_group(df: DataFrame, tag: str, x: str, by: Sequence[str], name: str, run) -> DataFrame:
    kinds = dict(df.dtypes)

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_x")
        return pd.DataFrame([(*key, run(f["_x"].to_numpy(float), f["_y"].to_numpy(float)))], columns=[*by, name])

    own = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(tag).cast("double").alias("_y")).dropna()
    return dealt(own, list(by)).groupBy(*by).applyInPandas(one, ", ".join([*(f"`{b}` {kinds[b]}" for b in by), f"`{name}` double"]))


def slope(df: DataFrame, tag: str, x: str, by: Sequence[str]) -> DataFrame:
    """Siegel's repeated-median slope against another column, one batch a time."""
    return _of_group(df, tag, x, by, f"{tag}_slope", repeated_median_slope_of)


def elbow(df: DataFrame, tag: str, x: str, by: Sequence[str]) -> DataFrame:
    return _of_group(df, tag, x, by, f"{tag}_elbow", lambda a, b: elbow_of(a, b) if len(a) > 10 else np.nan)


def melt(df: DataFrame, ids: Sequence[str], tags: Sequence[str]) -> DataFrame:
    """Wide to long: ids, tag, value."""
    return df.unpivot(list(ids), list(tags), "tag", "value")


#: Rows of one task that makes wide rows; its aggregates hold a key for each batch.
TASK_ROWS = 250_000


def widen(df: DataFrame, batch: str, sequence: str, tags: Sequence[str], positions: Sequence[int] | None = None) -> DataFrame:
    """Long to one row a batch, with a column for each tag and position (the largest value where a position repeats); all positions of the data, unless some are given.

    Rows are dealt by batch before anything is aggregated, to more tasks where they are more, so that no task holds more batches for it.
    """
    if positions is None:
        positions = [r[0] for r in df.select(sequence).filter(F.col(sequence).isNotNull()).distinct().orderBy(sequence).collect()]
    out = dealt(df.select(batch, sequence, *tags), [batch], TASK_ROWS).groupBy(batch).pivot(sequence, list(positions)).agg(*(F.max(t).alias(t) for t in tags))
    return out if len(tags) > 1 else out.select(batch, *(F.col(str(p)).alias(f"{p}_{tags[0]}") for p in positions))


def sequence(df: DataFrame, batch: str, age: str, name: str = "_sequence_") -> DataFrame:
    """Positions from 0 within each batch."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(batch).orderBy(age)) - 1)


def check_batches(df: DataFrame, batch: str, tags: Sequence[str], no_nulls: bool = False) -> dict:
    """Counts of rows, batches and missing values; raises if a tag is no number, or if one is missing and none may be."""
    kinds = dict(df.dtypes)
    wrong = [t for t in tags if kinds.get(t) not in ("double", "float", "int", "bigint", "smallint", "tinyint") and not str(kinds.get(t)).startswith("decimal")]
    if wrong:
        raise ValueError(f"these tags are no numbers: {wrong}")
    out = df.agg(F.count("*").alias("rows"), F.countDistinct(batch).alias("batches"), *(F.sum(F.col(t).isNull().cast("long")).alias(t) for t in tags)).first().asDict()
    if no_nulls and any(out[t] for t in tags):
        raise ValueError(f"values are missing: { {t: out[t] for t in tags if out[t]} }")
    return out
