"""Small published experiments, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Four published designed experiments, as they stand in their tables.
_POLLUTANT = [(-1, -1, -1, 5), (1, -1, -1, 30), (-1, 1, -1, 6), (1, 1, -1, 33), (-1, -1, 1, 4), (1, -1, 1, 3), (-1, 1, 1, 5), (1, 1, 1, 4)]
_GOLF = [
    (3, 9, "Titleist", "9:00", 305), (3, 1, "Callaway", "9:00", 295), (3, 9, "Titleist", "14:00", 288), (1, 1, "Titleist", "9:00", 300),
    (3, 9, "Callaway", "14:00", 260), (1, 9, "Titleist", "9:00", 298), (1, 9, "Titleist", "14:00", 281), (3, 9, "Callaway", "9:00", 278),
    (1, 1, "Callaway", "14:00", 265), (3, 1, "Callaway", "14:00", 282), (1, 9, "Callaway", "14:00", 230), (1, 1, "Callaway", "9:00", 288),
    (1, 1, "Titleist", "14:00", 292), (3, 1, "Titleist", "14:00", 300), (3, 1, "Titleist", "9:00", 312), (1, 9, "Callaway", "9:00", 235),
]
_SOLAR = [
    (-1, -1, -1, -1, 43.5, 82.0), (1, -1, -1, -1, 51.3, 83.7), (-1, 1, -1, -1, 35.0, 61.7), (1, 1, -1, -1, 38.4, 100.0),
    (-1, -1, 1, -1, 44.9, 82.1), (1, -1, 1, -1, 52.4, 84.1), (-1, 1, 1, -1, 39.7, 67.7), (1, 1, 1, -1, 41.3, 100.0),
    (-1, -1, -1, 1, 41.3, 82.0), (1, -1, -1, 1, 50.2, 86.3), (-1, 1, -1, 1, 37.5, 66.0), (1, 1, -1, 1, 39.2, 100.0),
    (-1, -1, 1, 1, 43.0, 82.2), (1, -1, 1, 1, 51.9, 89.8), (-1, 1, 1, 1, 39.9, 68.6), (1, 1, 1, 1, 41.6, 100.0),
]
_BOILING_POT = [
    (500, "Off", 2, 450), (600, "Off", 2, 492), (500, "On", 2, 390), (600, "On", 2, 408), (500, "Off", 3, 432), (600, "Off", 3, 450),
    (500, "On", 3, 318), (600, "On", 3, 312), (450, "Off", 2, 354), (550, "On", 3, 318), (550, "Off", 3, 420),
]

TABLES = {
    "pollutant": (_POLLUTANT, "C int, T int, S int, y double"),
    "golf": (_GOLF, "H int, N int, C string, T string, y double"),
    "solar": (_SOLAR, "A int, B int, C int, D int, y1 double, y2 double"),
    "boilingpot": (_BOILING_POT, "A double, B string, C double, y double"),
}


def data(spark: SparkSession, name: str) -> DataFrame:
    """A table by its name; an unknown one is an error that lists them."""
    if name not in TABLES:
        raise ValueError(f"no such table: {name}; there are {', '.join(sorted(TABLES))}")
    rows, schema = TABLES[name]
    kinds = [c.split()[1] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(float(v) if k == "double" else v for v, k in zip(r, kinds, strict=True)) for r in rows], schema)
