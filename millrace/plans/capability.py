"""Queries of process capability and control charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import add


@add(
    "cpk_by_supplier",
    """SELECT l_suppkey, count(*) AS n, round(least((50 - avg(l_quantity)) / (3 * stddev_samp(l_quantity)), (avg(l_quantity) - 1) / (3 * stddev_samp(l_quantity))), 6) AS cpk
    FROM lineitem GROUP BY l_suppkey""",
)
def cpk_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, sd = F.avg("l_quantity"), F.stddev_samp("l_quantity")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.least((50 - mean) / (3 * sd), (mean - 1) / (3 * sd)), 6).alias("cpk"))
