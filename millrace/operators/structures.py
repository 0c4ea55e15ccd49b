"""Factors, responses, constraints and columns of experiments; sets, levels and words of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.analyze import actual, coded


@dataclass(frozen=True)
class Factor:
    """A factor: a range of numbers, or levels of a category; mixture and hard_to_change say how it may be set."""

    name: str
    low: float | None = None
    high: float | None = None
    levels: tuple = ()
    units: str | None = None
    mixture: bool = False
    hard_to_change: bool = False

    def __post_init__(self) -> None:
        if self.levels:
            return
        if self.low is None or self.high is None or not self.low < self.high:
            raise ValueError(f"factor {self.name} needs levels, or a low below a high")

    @classmethod
    def from_data(cls, df: DataFrame, name: str) -> Factor:
        """The range of a number's column, or the levels of another one's."""
        if dict(df.dtypes)[name] in ("string", "boolean"):
            return cls(name, levels=tuple(sorted(r[0] for r in df.select(name).dropna().distinct().collect())))
        low, high = df.agg(F.min(name), F.max(name)).first()
        return cls(name, float(low), float(high))

    @property
    def center(self) -> float:
        return (self.low + self.high) / 2

    @property
    def range(self) -> float:
        return self.high - self.low

    def to_coded(self) -> Column:
        return coded(self.name, self.low, self.high)

    def to_realworld(self) -> Column:
        return actual(self.name, self.low, self.high)


@dataclass(frozen=True)
class Response:
    name: str
    goal: str = "maximize"
    low: float = 0.0
    high: float = 1.0
    target: float | None = None
    weight: float = 1.0
    importance: float = 1.0

    def as_goal(self) -> dict:
        return {"goal": self.goal, "low": self.low, "high": self.high, "target": self.target, "weight": self.weight}


@dataclass(frozen=True)
class Constraint:
    """sum of weights times factors, at most (or at least) a bound."""

    weights: tuple[tuple[str, float], ...]
    bound: float
    at_most: bool = True

    def holds(self) -> Column:
        total = F.lit(0.0)
        for f, w in self.weights:
            total = total + F.col(f) * float(w)
        return total <= self.bound if self.at_most else total >= self.bound


@dataclass
class Experiment:
    """A table of runs with its factors and a title."""

    df: DataFrame
    factors: list[Factor] = field(default_factory=list)
    title: str = ""

    def to_coded(self) -> DataFrame:
        return self.df.withColumns({f.name: f.to_coded() for f in self.factors if not f.levels})

    def to_realworld(self) -> DataFrame:
        return self.df.withColumns({f.name: f.to_realworld() for f in self.factors if not f.levels})

    def allowed(self, constraints: Sequence[Constraint]) -> DataFrame:
        out = self.df
        for c in constraints:
            out = out.filter(c.holds())
        return out

    def extend(self, more: DataFrame) -> Experiment:
        """The runs of another table after these; columns that one lacks are null."""
        return Experiment(self.df.unionByName(more, allowMissingColumns=True), self.factors, self.title)


def supplement(df: DataFrame, column: str, **metadata) -> DataFrame:
    """df with metadata (units, low, high, name, ...) of a column."""
    return df.withMetadata(column, {**df.schema[column].metadata, **metadata})


def gather(columns: Mapping[str, DataFrame], order: str) -> DataFrame:
    """One table of several one-value tables (order, value), joined by `order`; rows that lack a value are dropped, and unequal lengths are an error."""
    sizes = {name: df.count() for name, df in columns.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"columns of unequal lengths: {sizes}")
    out = None
    for name, df in columns.items():
        value = next(c for c in df.columns if c != order)
        own = df.select(order, F.col(value).alias(name))
        out = own if out is None else out.join(own, order)
    return out.dropna("any")


def unwiden(df: DataFrame, batch: str, columns: Sequence[str], tag: str = "tag", position: str = "position", value: str = "value") -> DataFrame:
    """Wide <tag>_<position> columns to one value a row."""
    long = df.unpivot([batch], list(columns), "_name", value).filter(F.col(value).isNotNull())
    parts = F.regexp_extract("_name", r"^(.*)_(\d+)$", 1), F.regexp_extract("_name", r"^(.*)_(\d+)$", 2).cast("int")
    return long.select(batch, parts[0].alias(tag), parts[1].alias(position), value)


def apply_correction(panel: DataFrame, drop: Sequence[str]) -> DataFrame:
    """The panel without the named panelists."""
    return panel.filter(~F.trim(F.col("panelist_id").cast("string")).isin(list(drop))) if drop else panel


def matched(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys the other table has."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


def key_sets(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key of either table and where it is: both, left or right."""
    own, other = a.select(*keys), b.select(*keys)
    label = lambda df, name: df.withColumn("found_in", F.lit(name))
    return label(own.intersect(other), "both").unionByName(label(own.distinct().exceptAll(other.distinct()), "left")).unionByName(label(other.distinct().exceptAll(own.distinct()), "right"))


def changed_means(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The mean of each key in both tables, over the union of their keys."""
    mean = lambda df, name: df.groupBy(*keys).agg(F.avg(value).alias(name))
    out = mean(before, "before").join(mean(after, "after"), list(keys), "full_outer")
    return out.withColumn("change", F.col("after") - F.col("before"))


def level_means(df: DataFrame, value: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Means of a value at several levels of grouping in one pass; columns that a level does not use are null, and `level` tells them apart."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns))
    return out.agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping_id().alias("level"))


def keyword_rank(entries: DataFrame, key: str, text: str, query: str, limit: int | None = None) -> DataFrame:
    """Entries by how many distinct words of the query they hold: words are runs of letters and digits, in lower case; `limit` makes a top-k."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1))
    index = entries.select(key, F.explode(words(F.col(text))).alias("word"))
    asked = index.sparkSession.range(1).select(F.explode(words(F.lit(query))).alias("word"))
    found = index.join(F.broadcast(asked), "word").groupBy(key).agg(F.count("*").alias("score"))
    return found.orderBy(F.desc("score"), key).limit(limit) if limit else found


def with_next(df: DataFrame, by: Sequence[str], order: str, column: str, name: str) -> DataFrame:
    """df and the next row's value of a column within each group."""
    return df.withColumn(name, F.lead(column).over(W.partitionBy(*by).orderBy(order)))
