"""Centring and scaling: one aggregate learns the numbers, a projection applies them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Scaler:
    """Means and standard deviations of columns; deviations that are tiny or unknown are 1, unknown means 0."""

    columns: tuple[str, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], center: bool = True, scale: bool = True) -> Scaler:
        clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        row = df.agg(*(F.avg(clean(c)).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_samp(clean(c)).alias(f"s{i}") for i, c in enumerate(columns))).first()
        mean = [row[f"m{i}"] if center and row[f"m{i}"] is not None and np.isfinite(row[f"m{i}"]) else 0.0 for i in range(len(columns))]
        sd = [row[f"s{i}"] if scale and row[f"s{i}"] is not None and np.isfinite(row[f"s{i}"]) and row[f"s{i}"] > TINY else 1.0 for i in range(len(columns))]
        return cls(tuple(columns), tuple(mean), tuple(sd))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / s for c, m, s in zip(self.columns, self.center, self.scale, strict=True)})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * s + m for c, m, s in zip(self.columns, self.center, self.scale, strict=True)})


def center(df: DataFrame, columns: Sequence[str], how=F.avg) -> DataFrame:
    """Columns less an aggregate of each."""
    row = df.agg(*(how(c).alias(c) for c in columns)).first()
    return df.withColumns({c: F.col(c) - F.lit(row[c]) for c in columns})


def scale(df: DataFrame, columns: Sequence[str], how=F.stddev_pop) -> DataFrame:
    """Columns over an aggregate of each; zero counts as one."""
    row = df.agg(*(how(c).alias(c) for c in columns)).first()
    return df.withColumns({c: F.col(c) / F.lit(float(row[c]) if row[c] else 1.0) for c in columns})


def batch_ranges(df: DataFrame, batch: str, tags: Sequence[str], robust: bool = True) -> DataFrame:
    """tag, range, minimum: medians (robust) or means over batches of each batch's range and minimum; a range of 0 is 1."""
    long = df.unpivot([batch], list(tags), "tag", "x").dropna()
    spread = F.percentile("x", F.lit(0.98)) - F.percentile("x", F.lit(0.02)) if robust else F.max("x") - F.min("x")
    return middle_ranges(long.groupBy(batch, "tag").agg(spread.alias("r"), F.min("x").alias("m")), robust)


def ranges_of_arrays(df: DataFrame, tags: Sequence[str], robust: bool = True) -> DataFrame:
    """`batch_ranges` of one row a batch, whose tags are arrays without missing values."""
    rows = df.select(*(F.sort_array(t).alias(t) for t in tags))

    def at(t: str, p: float) -> Column:
        place = (F.size(t) - 1) * F.lit(p)
        low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
        return F.when(low == high, F.get(t, low)).otherwise((high - place) * F.get(t, low) + (place - low) * F.get(t, high))

    ends = (lambda t: (at(t, 0.02), at(t, 0.98))) if robust else (lambda t: (F.get(t, F.lit(0)), F.element_at(t, -1)))
    own = [F.struct(F.lit(t).alias("tag"), (ends(t)[1] - ends(t)[0]).alias("r"), F.get(t, F.lit(0)).alias("m")) for t in tags]
    return middle_ranges(rows.select(F.inline(F.array(*own))), robust)


def middle_ranges(own: DataFrame, robust: bool) -> DataFrame:
    """tag, range, minimum: medians or means of each batch's range r and minimum m."""
    own = own.withColumn("r", F.when(F.col("r") == 0, 1.0).otherwise(F.col("r")))
    how = F.median if robust else F.avg
    return own.groupBy("tag").agg(how("r").alias("range"), how("m").alias("minimum"))


def apply_ranges(df: DataFrame, ranges: DataFrame, tags: Sequence[str], back: bool = False) -> DataFrame:
    """(x - minimum) / range of each tag, or back; the ranges are one row a tag."""
    known = {r["tag"]: (r["range"], r["minimum"]) for r in ranges.collect()}
    return df.withColumns({t: F.col(t) * known[t][0] + known[t][1] if back else (F.col(t) - known[t][1]) / known[t][0] for t in tags if t in known})
